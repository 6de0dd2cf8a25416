"""From OCR words to the best text of an image, and where the image goes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions.text import clean_ocr, strip

#: Image variants, rotation angles in their order, limits.
VARIANTS = (0, 1, 2, 3)
ANGLES = (0, 90, 270)
LEAST_CONFIDENCE, LEAST_LENGTH, LONGEST_SIDE = 40, 10, 2000


def candidates(spark: SparkSession, images: DataFrame) -> DataFrame:
    """``images`` with every ``variant`` and ``angle``: twelve rows each."""
    grid = spark.createDataFrame([(v, a, i) for v in VARIANTS for i, a in enumerate(ANGLES)], "variant int, angle int, angle_idx int")
    return images.crossJoin(F.broadcast(grid))


def usable(words: DataFrame) -> DataFrame:
    """Words of positive whole confidence that are not blank."""
    return words.filter((F.col("conf").cast("int") > 0) & (strip(F.col("text")) != ""))


def texts(words: DataFrame) -> DataFrame:
    """``image_id, variant, angle, raw, conf``: words in order joined by spaces, and their mean confidence.

    Words are brought together by image, so what follows for an image needs no exchange of its texts.
    """
    rows = usable(words).repartition("image_id").groupBy("image_id", "variant", "angle")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", strip(F.col("text")).alias("t")))), lambda x: x["t"]), " ")
    return rows.agg(joined.alias("raw"), F.avg("conf").alias("conf"))


def best_text(images: DataFrame, words: DataFrame) -> DataFrame:
    """``image_id, ocr_text, ocr_confidence``: the most confident cleaned text of over five characters.

    Confidence is of the raw words; of equal ones the first variant and angle wins; images without a
    candidate get '' and 0. Candidates are put in order first and cleaned one by one until one passes.
    """
    place = F.array_position(F.array(*map(F.lit, ANGLES)), F.col("angle"))
    found = texts(words).filter(F.col("conf") > 0)
    tries = found.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("order"), "variant", place.alias("place"), "raw", "conf"))).alias("tries"))
    cleaned = lambda t: F.struct(clean_ocr(t["raw"]).alias("ocr_text"), t["conf"].alias("ocr_confidence"))
    nth = lambda i: F.get(F.filter(F.transform(F.slice("tries", i + 1, 1), cleaned), lambda t: F.length(t["ocr_text"]) > 5), 0)
    best = tries.select("image_id", F.coalesce(*map(nth, range(len(VARIANTS) * len(ANGLES)))).alias("best"))  # the rest is not looked at
    out = images.select("image_id").join(best, "image_id", "left")
    return out.select("image_id", F.coalesce("best.ocr_text", F.lit("")).alias("ocr_text"), F.coalesce("best.ocr_confidence", F.lit(0.0)).alias("ocr_confidence"))


def route(confidence: Column, text: Column) -> Column:
    """How an image is analysed: by its text, or by looking at it."""
    return F.when((confidence < LEAST_CONFIDENCE) | (F.length(text) < LEAST_LENGTH), "vision_fallback").otherwise("ocr")


def scale(width: Column, height: Column) -> Column:
    """Factor that brings the longest side down to the limit; 1 for smaller images."""
    longest = F.greatest(width, height)
    return F.when(longest > LONGEST_SIDE, F.lit(float(LONGEST_SIDE)) / longest).otherwise(F.lit(1.0))


def rotated_size(width: Column, height: Column, angle: Column) -> tuple[Column, Column]:
    """Whole width and height of the canvas that holds the rotated image."""
    cos, sin = F.abs(F.cos(F.radians(angle))), F.abs(F.sin(F.radians(angle)))
    return (height * sin + width * cos).cast("int"), (height * cos + width * sin).cast("int")
