"""JSON in model replies and in stored results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmatch.functions.text import or_default, strip
from quillmatch.schemas import ANALYSIS_LISTS, ANALYSIS_TEXTS


def extract_json(reply: Column) -> Column:
    """The JSON of a model's reply as text: of the first fenced block if any, else of the whole; else from the first
    brace to the last; else ``{}``. Only what parses counts."""
    # What fences the JSON of a reply, and from which brace to which it reaches without fences.
    fence = r"```(?:json)?\s*([\s\S]*?)```"
    body = strip(F.when(F.regexp_like(reply, F.lit(fence)), F.regexp_extract(reply, fence, 1)).otherwise(reply))
    braces = F.regexp_extract(body, r"\{[\s\S]*\}", 0)
    parses = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(parses(body), parses(braces), F.lit("{}"))


def strict_json(json: Column) -> Column:
    """A stored result as a variant; blank is ``{}``. Bad JSON fails the query, as reading one scan or chatting about it does."""
    return F.parse_json(F.coalesce(F.nullif(json, F.lit("")), F.lit("{}")))


def opens(json: Column) -> Column:
    """Whether ``strict_json`` would not fail."""
    return F.try_parse_json(F.coalesce(F.nullif(json, F.lit("")), F.lit("{}"))).isNotNull()


def has_key(json: Column, key: str) -> Column:
    """Whether an object has a key, a null value included."""
    return F.array_contains(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), key)


def stored_field(json: Column, key: str, default: str) -> Column:
    """A top-level text of a stored result; ``default`` where it is missing, blank or the JSON is bad."""
    return or_default(F.get_json_object(json, f"$.{key}"), default)


def stored_field_anywhere(json: Column, key: str, default: str) -> Column:
    """As ``stored_field``, but results wrapped in an envelope count too (an extension)."""
    return or_default(F.coalesce(F.nullif(F.get_json_object(json, f"$.data.{key}"), F.lit("")), F.get_json_object(json, f"$.{key}")), default)


def analysis(json: Column, brand_default: Column | None = None) -> Column:
    """An analysis struct with the default of each field where its key is missing; a null stays null."""
    text = lambda k, d: F.when(has_key(json, k), F.get_json_object(json, f"$.{k}")).otherwise(d)
    lists = lambda k: F.when(has_key(json, k), F.from_json(F.get_json_object(json, f"$.{k}"), "array<string>")).otherwise(F.array().cast("array<string>"))
    first = {"brand_name": brand_default} if brand_default is not None else {}
    fields = [text(k, first.get(k, F.lit(""))).alias(k) for k in ANALYSIS_TEXTS] + [lists(k).alias(k) for k in ANALYSIS_LISTS]
    return F.struct(*fields, F.when(has_key(json, "confidence"), F.get_json_object(json, "$.confidence").try_cast("double")).otherwise(F.lit(0.0)).alias("confidence"))


def valid_analysis(json: Column) -> Column:
    """Whether every list field that is present is a list: a null or other value fails the reply."""
    ok = F.lit(True)
    for k in ANALYSIS_LISTS:
        value = F.get_json_object(json, f"$.{k}")
        ok = ok & (~has_key(json, k) | F.coalesce(F.json_array_length(value).isNotNull(), F.lit(False)))
    return ok


def error_of(json: Column) -> Column:
    """The error that a reply carries, null if none."""
    return F.when(has_key(json, "error"), F.coalesce(F.get_json_object(json, "$.error"), F.lit("")))
