"""Operational tables as Parquet folders, partitioned by a hash of the key that they are changed by.

A change reads and writes only the partitions that its keys fall into, whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.operators.store import absent
from quillmatch.schemas import OPERATIONAL
from quillmatch.sources.scratch import remove, stored

PARTS = 16  #: Partitions of a table; to be set by the size it is to reach, once and for all.
#: The key of each table; what has none is only appended to.
KEYS = {"users": "email", "scans": "id", "chat_messages": "scan_id", "system_metrics": None}


def part_of(name: str, key: str | None = None) -> Column:
    """The partition of a row of a table, by its key or by a column that holds keys."""
    column = key or KEYS[name]
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int") if column else F.lit(0)


def create(spark: SparkSession, root: str) -> None:
    """The tables that are not there yet, empty."""
    for name, schema in OPERATIONAL.items():
        spark.createDataFrame([], schema).withColumn("part", F.lit(0)).write.mode("ignore").partitionBy("part").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str, parts: list[int] | None = None) -> DataFrame:
    """The table, or the rows in some of its partitions; the others' files are not opened."""
    rows = spark.read.schema(f"{OPERATIONAL[name].toDDL()}, part INT").parquet(f"{root}/{name}")
    if parts is not None:
        rows = rows.filter(F.col("part").isin(parts))
    return rows.drop("part")


def append(rows: DataFrame, root: str, name: str) -> None:
    """Appends rows; missing columns are null, a missing numeric id is new and unique within the table's writes."""
    schema = OPERATIONAL[name]
    fill = lambda f: (F.xxhash64(F.expr("uuid()")) if f.name == "id" and f.dataType.simpleString() == "bigint" else F.lit(None)).cast(f.dataType)
    filled = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else fill(f).alias(f.name) for f in schema])
    _dealt(filled, name).write.mode("append").partitionBy("part").parquet(f"{root}/{name}")


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("part", part_of(name))


def _parts(keys: DataFrame, name: str, key: str) -> list[int]:
    """The partitions that keys fall into: ``PARTS`` at most."""
    return sorted(r["part"] for r in keys.select(part_of(name, key).alias("part")).distinct().collect())


def replace(rows: DataFrame, root: str, name: str, parts: list[int] | None = None) -> None:
    """Puts ``rows`` in place of a table, or of some of its partitions, that they may be computed from.

    They are written aside first; partitions that no row is left for go.
    """
    spark, path = rows.sparkSession, f"{root}/{name}"
    aside = stored(_dealt(rows, name), f"new-{name}")
    aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if parts is not None else "static").partitionBy("part").parquet(path)
    if parts is not None:
        kept = {r["part"] for r in aside.select("part").distinct().collect()}
        for part in set(parts) - kept:
            remove(spark, f"{path}/part={part}")


def insert_absent(new: DataFrame, root: str, name: str, order: str) -> None:
    """Appends the rows of ``new`` whose key the table lacks, of equal ones the first by ``order``; no row that is there is written again."""
    key = KEYS[name]
    known = read(new.sparkSession, root, name, _parts(new, name, key))
    append(stored(absent(known, new, key, order), f"fresh-{name}"), root, name)


def delete(ids: DataFrame, root: str, name: str) -> None:
    """Deletes the rows whose key is in ``ids``, a table of one column; unknown keys change nothing."""
    (column,), key = ids.columns, KEYS[name]
    gone = ids.select(F.col(column).alias(key)).distinct()
    parts = _parts(gone, name, key)
    replace(read(ids.sparkSession, root, name, parts).join(gone, key, "left_anti"), root, name, parts)


def delete_scans(ids: DataFrame, root: str) -> None:
    """Scans of ``ids(id)`` with their messages; messages first, so a failure between leaves none without a scan."""
    delete(ids.select(F.col("id").alias("scan_id")), root, "chat_messages")
    delete(ids.select("id"), root, "scans")
