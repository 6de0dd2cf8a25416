"""Schemas of catalogues, operational tables, and results."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: Column headers of the three catalogues.
BRANDED = strings("name", "price(₹)", "Is_discontinued", "manufacturer_name", "type", "pack_size_label", "short_composition1", "short_composition2")
GENERICS = strings("Generic Name", "MRP", "Unit Size", "Group Name")
MASTER = strings(
    "brand_raw", "brand_clean", "canonical_inn", "composition_raw", "manufacturer", "is_generic", "product_price", "nppa_price", "price_flag", "ratio_market_to_nppa"
)

USERS = T.StructType().add("id", "string", False).add("email", "string", False).add("name", "string").add("avatar", "string").add("created_at", T.TimestampNTZType())
SCANS = (
    T.StructType()
    .add("id", "string", False)
    .add("user_id", "string")
    .add("image_path", "string", False)
    .add("result_json", "string")
    .add("ocr_text", "string")
    .add("ocr_confidence", "double")
    .add("method", "string")
    .add("created_at", T.TimestampNTZType())
)
CHAT_MESSAGES = (
    T.StructType().add("id", "long", False).add("scan_id", "string", False).add("role", "string", False).add("content", "string", False).add("created_at", T.TimestampNTZType())
)
SYSTEM_METRICS = (
    T.StructType().add("id", "long", False).add("endpoint", "string", False).add("response_time_ms", "long").add("status_code", "long").add("created_at", T.TimestampNTZType())
)
OPERATIONAL = {"users": USERS, "scans": SCANS, "chat_messages": CHAT_MESSAGES, "system_metrics": SYSTEM_METRICS}

ALTERNATIVE = strings("name", "price", "source", "drug_code")
#: Fields of an analysis: texts, lists of texts, and a number.
ANALYSIS_TEXTS = ("brand_name", "generic_name", "composition", "form", "manufacturer", "schedule_type", "dosage", "storage", "simplified_explanation")
ANALYSIS_LISTS = ("indications", "uses", "side_effects", "precautions", "contraindications", "interactions", "warnings")
WORDS = T.StructType().add("image_id", "string").add("variant", "integer").add("angle", "integer").add("word_idx", "integer").add("text", "string").add("conf", "double")
