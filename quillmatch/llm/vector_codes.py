"""Vector compression to short codes: codebooks of vector parts, fitted by an RDD ``treeAggregate`` over columnar blocks.

Vectors are quantised to integers and written as blocks of a few thousand, each a numpy array with one row
a component. A round of fitting adds the parts of every block to int64 tensors of sums and counts, which
merge up a reduction tree, so the driver gets one pair of tensors of the codebooks' own size whatever the
number of vectors. All arithmetic is on integers, so results do not depend on the order of merging.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.grouping import hot_from, meet
from quillmatch.llm.shared import in_tasks, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256  #: Parts of a vector, entries of a part's codebook, rounds of fitting, steps to a unit.
BLOCK = 4096  #: Vectors of a block.
COMPONENTS = 1 << 22  #: Components of a block at most.
AT_ONCE = 1024  #: Vectors whose distances to all entries a task holds at once.
DEPTH = 3  #: Levels of the reduction tree.
NARROW = 1 << 24  #: Components below this in size are int64; up to 8,000 of them no sum overflows. Others are Python integers.
LONGEST = (1 << 63) - 1


def quantised(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` of finite doubles: int64, or exact Python integers where one is too large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if not x.size or np.abs(scaled).max() < NARROW:
        return scaled.astype(np.int64)
    return np.frompyfunc(lambda v: math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE, 1, 1)(x)  # so large a double is whole


def smallest(q: np.ndarray) -> np.ndarray:
    """Python integers as int64 where all are small enough."""
    return q.astype(np.int64) if q.dtype == object and all(abs(v) < NARROW for v in q.ravel()) else q


def packed(q: np.ndarray) -> tuple[bytes | None, str | None]:
    """A block as bytes, or as text where a component needs more than 32 bits."""
    if q.dtype == np.int64:
        return q.astype("<i4").tobytes(), None
    return None, ",".join(map(str, q.ravel()))


def unpacked(body: bytes | None, wide: str | None, n: int) -> np.ndarray:
    """A block as components x vectors."""
    if wide is None:
        return np.frombuffer(body, "<i4").astype(np.int64).reshape(-1, n)
    q = np.empty(wide.count(",") + 1, object)
    q[:] = [int(v) for v in wide.split(",")]
    return q.reshape(-1, n)


def finite(c: str):
    """Whether an array has no null and no component that is not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(c).isNotNull() & ~F.coalesce(F.exists(c, bad), F.lit(False))


def columns(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Lists of doubles as components x vectors, zeros after the end of shorter ones."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out.T


def blocks(kept: DataFrame, width: int, size: int = BLOCK) -> DataFrame:
    """``n, ids, labels, body, wide``: the vectors of ``kept(vec_id, label, embedding)`` in columnar blocks of up to ``size``, less for very long vectors."""
    size = max(1, min(size, COMPONENTS // width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                body, wide = packed(quantised(columns(part.column(2), width)))
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.num_rows], pa.int32()), one(part.column(0)), one(part.column(1)), pa.array([body], pa.binary()), pa.array([wide], pa.string())], names=["n", "ids", "labels", "body", "wide"]
                )

    kind = lambda c: kept.schema[c].dataType.simpleString()
    return in_tasks(kept, run, f"n int, ids array<{kind('vec_id')}>, labels array<{kind('label')}>, body binary, wide string")


def narrow(*arrays: np.ndarray) -> bool:
    return all(a.dtype == np.int64 and (not a.size or np.abs(a).max() < NARROW) for a in arrays)


def nearest(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance (both parts x vectors) of every part of the block ``q`` in ``books`` (parts x entries x components).

    Distances to all entries add up component by component; of equal ones the first entry is taken.
    """
    parts, entries, step = books.shape
    kind = np.int64 if narrow(q, books) else object
    q, books, n = q.astype(kind), books.astype(kind), q.shape[1]
    codes, gaps = np.zeros((parts, n), np.int64), np.zeros((parts, n), kind)
    for start in range(0, n, AT_ONCE):
        piece = q[:, start : start + AT_ONCE]
        for p in range(parts):
            far = np.zeros((entries, piece.shape[1]), kind)
            for k in range(step):
                off = books[p, :, k, None] - piece[p * step + k]
                far += off * off
            at = far.argmin(axis=0)
            codes[p, start : start + AT_ONCE] = at
            gaps[p, start : start + AT_ONCE] = far[at, np.arange(piece.shape[1])]
    return codes, gaps


def tensors(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts x entries x components) and counts (parts x entries) of the parts of a block by their nearest entry."""
    parts, entries, step = books.shape
    codes, _ = nearest(q, books)
    sums, counts = np.zeros(books.shape, q.dtype), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        np.add.at(counts[p], codes[p], 1)
        np.add.at(sums[p], codes[p], q[p * step : (p + 1) * step].T)
    return sums, counts


def merged(a, b):
    """Two pairs of tensors as one; None is none."""
    if a is None or b is None:
        return a if b is None else b
    return a[0] + b[0], a[1] + b[1]


def fitted(table: DataFrame, books: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> np.ndarray:
    """``books`` after ``rounds`` of assigning every part of ``table`` (of ``blocks``) and moving each used entry to the floor of its parts' mean."""
    context = table.sparkSession.sparkContext
    data = table.select("n", "body", "wide").rdd
    for _ in range(rounds):
        sent = context.broadcast(books)  # of the codebooks' own size, which no number of vectors changes
        total = data.treeAggregate(None, lambda acc, row: merged(acc, tensors(unpacked(row["body"], row["wide"], row["n"]), sent.value)), merged, depth)
        sent.unpersist()
        if total is not None:
            sums, counts = total
            used = counts > 0
            means = sums // np.maximum(counts, 1)[:, :, None]
            books = smallest(np.where(used[:, :, None], means, books))
    return books


def coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector of ``table`` (of ``blocks``)."""
    sent = table.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                q = unpacked(row.column("body")[0].as_py(), row.column("wide")[0].as_py(), row.column("n")[0].as_py())
                codes, gaps = nearest(q, sent.value)
                texts = [b.tobytes().hex() for b in codes.T.astype(np.uint8)]
                error = [min(int(v), LONGEST) for v in gaps.sum(axis=0)]
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(), pa.array(texts, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    item = lambda c: table.schema[c].dataType.elementType.simpleString()
    return in_tasks(table, run, f"vec_id {item('ids')}, label {item('labels')}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """One row per vector of ``vectors(vec_id, embedding, label)`` that is kept: ``vec_id, code, error, label_error, codebooks_sha256``.

    Vectors that are null or hold null or non-finite components go; repeated rows each count and get a row. The
    codebooks start as the parts of the ``entries`` smallest ``vec_id`` (null last, ties by the vector; all vectors
    where there are fewer). A vector shorter than the longest, or than a multiple of ``parts``, is as if zeros
    followed. Null labels are one label. Components of any finite size are computed exactly; an error beyond a
    long is the largest long. Further columns are ignored; an empty table gives an empty result.
    """
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(finite("embedding"))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(-(-longest // parts), 1) * parts
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()  # a fixed number of rows
    start = np.zeros((len(first), width))
    for i, row in enumerate(first):
        start[i, : len(row["embedding"])] = row["embedding"]
    books = quantised(start).reshape(len(first), parts, width // parts).swapaxes(0, 1)
    table = written(blocks(kept, width, block), "codes-blocks")
    if first:
        books = fitted(table, books, rounds)
    rows = written(coded(table, books).withColumn("key", F.struct("label")), "codes-rows")
    # Sums that exceed a long are capped too: they are added up as decimals.
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    sums = sums.select("key", "n", F.least("s", F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    out = meet(rows, sums, "key", hot_from(rows.count()))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(k: int) -> str:
    """WITH-item ``a{k}(rid, p, c, d)``: the nearest entry of codebooks ``b{k}(p, c, v)`` for every part."""
    gap = "list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"a{k} AS (SELECT rid, p, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT q.rid, q.p, b.c, CAST({gap} AS BIGINT) AS d FROM q JOIN b{k} b ON q.p = b.p) GROUP BY rid, p)"


def _moved(k: int) -> str:
    """WITH-item ``b{k + 1}``: the codebooks after a round."""
    return f"""s{k} AS (SELECT p, c, list(m ORDER BY j) AS v FROM (SELECT a.p, a.c, j, CAST(floor(sum(q.v[j]) / count(*)::DOUBLE) AS BIGINT) AS m
        FROM a{k} a JOIN q ON a.rid = q.rid AND a.p = q.p, unnest(range(1, len(q.v) + 1)) u(j) GROUP BY a.p, a.c, j) GROUP BY p, c),
    b{k + 1} AS (SELECT b.p, b.c, coalesce(s.v, b.v) AS v FROM b{k} b LEFT JOIN s{k} s ON b.p = s.p AND b.c = s.c)"""


#: The same in DuckDB, for vectors of one length that the parts divide.
ORACLE_SQL = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT rid, p, list_transform(list_slice(embedding, p * len(embedding) // {PARTS} + 1, (p + 1) * len(embedding) // {PARTS}), lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM e, unnest(range(0, {PARTS})) u(p)),
b0 AS (SELECT p, rid - 1 AS c, v FROM q WHERE rid <= {ENTRIES}),
{_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS sha FROM b2),
r AS (SELECT rid, string_agg(printf('%02x', c), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM r JOIN e ON r.rid = e.rid, h
"""
