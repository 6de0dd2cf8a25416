"""What a result page shows, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import or_default, percent


def header() -> list[Column]:
    """Title, price badge, method badge and confidence of an analysis row."""
    flag, method = F.col("price_flag"), F.col("method")
    return [
        or_default(F.col("brand_name"), or_default(F.col("generic_name"), "Unknown Medicine")).alias("title"),
        F.when(flag == "overpriced", "overpriced").when(flag == "ok", "fair").alias("price_badge"),
        F.when(method == "vision_fallback", "vision").otherwise("ocr").alias("method_badge"),
        percent(F.col("confidence")).alias("confidence_label"),
    ]


def sections(rows: DataFrame, key: str, lists: tuple[str, ...]) -> DataFrame:
    """``key, section, item_no, item`` for the list columns that hold something; objects show their name, else their JSON."""
    named = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("items")) for c in lists])
    full = rows.select(key, F.explode(F.filter(named, lambda s: F.size(s["items"]) > 0)).alias("s"))
    items = full.select(key, F.col("s.section").alias("section"), F.posexplode("s.items").alias("item_no", "raw"))
    is_object = F.get_json_object("raw", "$").startswith("{")
    return items.select(key, "section", "item_no", F.when(is_object, F.coalesce(F.get_json_object("raw", "$.name"), F.col("raw"))).otherwise(F.col("raw")).alias("item"))
