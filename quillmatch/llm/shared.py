"""Helpers that the operators of this subpackage share: written intermediates, row keys and bounded memory in tasks."""

from __future__ import annotations

import gc
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.sources.scratch import new_path, remove

#: Words of all the text contracts: runs of anything but space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8_000_000  #: Text that a task holds as Python objects at once; a longer text is one slice alone.

_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_CACHES: dict[str, dict] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    It cuts the lineage in a way that outlives executors, and it fixes values (row ids, sizes) that
    later steps must see unchanged. What ``discard`` did not delete before goes when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote for these tables; nothing that is still to be computed may read them."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            remove(table.sparkSession, path)


def row_key(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """Columns ``rk_id`` (the id) and ``rk_a, rk_b``, a 128-bit hash of id and text that names a row.

    Unlike a generated row number they come out the same in every scan of the same rows.
    """
    body, key = F.col(text), F.col(doc_id)
    return [
        key.alias("rk_id"),
        F.xxhash64(F.lit("a"), key.isNull(), key, body.isNull(), body).alias("rk_a"),
        F.xxhash64(F.lit("b"), body, F.length(body), key).alias("rk_b"),
    ]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    """Equality of the row keys of two tables."""
    return (left["rk_a"] == right["rk_a"]) & (left["rk_b"] == right["rk_b"])


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as the one column ``row``, so that no name of theirs meets one of an operator's."""
    return F.struct("*").alias("row")


def one_of_repeats(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of one row of those in ``keyed(row, rk_a, rk_b)`` that repeat a row key: the first by its other columns."""
    rest = [F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(columns) if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    return keyed.groupBy("rk_a", "rk_b").agg(F.min_by("row", F.coalesce(order, F.lit(""))).alias("row")).select("row.*")


def cache_of(owner: str | None) -> dict:
    """A cache that the tasks of one operator share within a reused Python worker.

    Asking for it frees the caches of all other operators, so that a worker never holds two.
    """
    others = [name for name in _CACHES if name != owner]
    for name in others:
        del _CACHES[name]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _CACHES.setdefault(owner, {}) if owner else {}


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, text: int | None = None) -> DataFrame:
    """``df.mapInArrow``; a task starts without other operators' caches, and gets batches cut by the bytes of column ``text``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of(None)
        return run(batches if text is None else slices(batches, text))

    return df.mapInArrow(task, schema)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose column ``text`` (a text, or a row that has one) has at most ``most`` bytes (a longer text is one alone)."""
    for batch in batches:
        body = batch.column(text)
        if pa.types.is_struct(body.type):  # a whole row
            body = body.field(body.type.get_field_index("text"))
        upto = np.cumsum(pc.fill_null(pc.binary_length(body), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def with_texts(rows: pa.StructArray, names: list[str], texts: list[str | None]) -> list[pa.Array]:
    """The columns of ``rows`` with other texts, and ``n_chars`` (if it is there) after them."""
    columns = rows.flatten()
    columns[names.index("text")] = pa.array(texts, columns[names.index("text")].type)
    if "n_chars" in names:
        at = names.index("n_chars")
        columns[at] = pa.array([None if t is None else len(t) for t in texts], columns[at].type)
    return columns
