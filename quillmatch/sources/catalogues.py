"""Catalogue files and uploaded images."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmatch.functions.text import extension
from quillmatch.schemas import BRANDED, GENERICS, MASTER

#: File of each catalogue, what may be uploaded.
FILES = {"generics": ("generic.csv", GENERICS), "branded": ("A_Z_medicines_dataset_of_India.csv", BRANDED), "master": ("master_medicines_final.csv", MASTER)}
IMAGE_TYPES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
MOST_BYTES = 10 * 1024 * 1024


def read_csv(spark: SparkSession, path: str, fallback: StructType | None = None) -> DataFrame:
    """All columns of a CSV file as text, blank and missing cells as '', with ``doc_id`` in row order.

    The header names the columns; quoted line feeds and doubled quotes are read as such; surplus cells
    are dropped. A path that is not there gives an empty table of the ``fallback`` columns.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}
    try:
        names = spark.read.options(**options).csv(path).columns
    except AnalysisException as e:
        if fallback is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType([StructField("doc_id", StringType())] + fallback.fields)).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = spark.read.options(**options).schema(StructType([StructField(n, StringType()) for n in names])).csv(path)
    return rows.select(F.monotonically_increasing_id().alias("doc_id"), *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def load(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """The three catalogues under a folder; a missing file is an empty catalogue."""
    return {name: read_csv(spark, f"{data_dir}/{file}", schema) for name, (file, schema) in FILES.items()}


def row_counts(catalogues: dict[str, DataFrame]) -> DataFrame:
    """``catalogue, n`` of each."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("catalogue"), "n") for name, df in catalogues.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def acceptable(files: DataFrame) -> DataFrame:
    """Files ``(path, length)`` of an image type that are not empty and not too large."""
    return files.filter(extension(F.col("path")).isin(*IMAGE_TYPES) & (F.col("length") > 0) & (F.col("length") <= MOST_BYTES))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Acceptable images under a path: ``path, modificationTime, length, content``."""
    return acceptable(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
