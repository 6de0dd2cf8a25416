"""Translation: which model, which pieces, and how they come together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import chunks, strip

#: Target language -> public translation model.
MODELS = {
    "hi-IN": "Helsinki-NLP/opus-mt-en-hi",
    "ta-IN": "Helsinki-NLP/opus-mt-en-ta",
    "te-IN": "Helsinki-NLP/opus-mt-en-te",
    "bn-IN": "Helsinki-NLP/opus-mt-en-bn",
    "mr-IN": "Helsinki-NLP/opus-mt-en-mr",
}
ANY_MODEL = "Helsinki-NLP/opus-mt-en-mul"


def pick(key: Column, table: dict[str, str], default: str) -> Column:
    """The table's value for a key, or the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(key, F.lit(""))), F.lit(default))


def model_for(language: Column) -> Column:
    return pick(language, MODELS, ANY_MODEL)


def prompt(text: Column, language: Column, instruction: str = "Target language: {}. Answer with the translated text.") -> Column:
    """What a text model is asked where the translation models gave nothing: the instruction with the language in its braces, then the text."""
    before, after = instruction.split("{}")
    return F.concat(F.lit(before), language, F.lit(f"{after}\n"), text)


def pieces(texts: DataFrame, width: int = 450) -> DataFrame:
    """``text_id, language, model, piece, chunk`` of ``texts(text_id, text, language)``; the source language needs none."""
    rows = texts.filter(F.col("language") != "en-US")
    return rows.select("text_id", "language", model_for(F.col("language")).alias("model"), F.posexplode(chunks(F.col("text"), width)).alias("piece", "chunk"))


def joined(texts: DataFrame, translated: DataFrame, second: Column | None = None) -> DataFrame:
    """``text_id, translation`` from ``translated(text_id, piece, chunk, translation)``.

    A piece that failed (null) keeps its source; pieces are joined by spaces; a blank whole falls back
    to ``second`` (another service's reply, a column of ``texts``) and then to the text itself.
    """
    piece = F.struct("piece", F.coalesce("translation", "chunk").alias("t"))
    whole = translated.groupBy("text_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["t"]), " ").alias("whole"))
    first = F.when(strip(F.col("whole")) != "", F.col("whole"))
    out = texts.join(whole, "text_id", "left")
    choice = F.coalesce(first, second, F.col("text")) if second is not None else F.coalesce(first, F.col("text"))
    return out.select("text_id", F.when(F.col("language") == "en-US", F.col("text")).otherwise(choice).alias("translation"))


def localised(requests: DataFrame, table: DataFrame, default: str = "en-US") -> DataFrame:
    """``requests(locale, ...)`` with every ``key, value`` of the locale in ``table(locale, key, value)``.

    An unknown locale is the default as a whole; a key that a known locale lacks is absent.
    """
    known = table.select(F.col("locale").alias("known")).distinct()
    chosen = requests.join(known, requests["locale"] == known["known"], "left").withColumn("used", F.coalesce("known", F.lit(default)))
    strings = table.select(F.col("locale").alias("used"), "key", "value")
    return chosen.join(strings, "used").drop("known", "used")
