"""Whole documents searched by exact cosine of their character n-grams: vectors in rows, queries in blocks.

In long texts of one language nearly every pair shares most of its n-grams, so an inverted index joins
almost everything with everything, and its common n-grams are hot keys. Here no n-gram is a join key: each
distinct document is one row with its n-grams and counts, a block of queries is a small matrix that is sent to
the tasks, and a task multiplies its documents with it and keeps the best few for each query. The index
is read where it lies; only those best few are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions.text import normalise, round3
from quillmatch.operators.match import RANK_DIGITS, THRESHOLD, best_rows, corpus_rows, distinct_texts, least_ids
from quillmatch.sources.scratch import new_path, stored

BASE = 38  #: Codes of a gap between texts (0), of the space (1), of 0-9 and a-z; at most three or four of them make a code below BASE**4.
BATCH_CHARS = 2_000_000  #: Characters whose n-grams are counted at once.
CELLS = 4_000_000  #: Numbers of a block's matrix (n-grams x queries).
PART = 2_000_000  #: N-grams of all queries that are sent at once; more queries take more passes over the index.
DOCS = 512  #: Documents that are multiplied with a block at once.

_CODE = np.zeros(256, np.int64)
_CODE[ord(" ")] = 1
_CODE[ord("0") : ord("9") + 1] = np.arange(2, 12)
_CODE[ord("a") : ord("z") + 1] = np.arange(12, 38)


def gram_codes(flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start and code of every n-gram in ``flat`` (codes of characters): two to four of one word with a space on both sides."""
    for n in (2, 3, 4):
        m = len(flat) - n + 1
        if m <= 0:
            return
        parts = [flat[k : k + m] for k in range(n)]
        good = (parts[0] > 0) & (parts[-1] > 0)
        for p in parts[1:-1]:
            good &= p > 1  # a space is at an end of an n-gram only
        if n == 2:
            good &= (parts[0] > 1) | (parts[1] > 1)
        code = parts[0].copy()
        for p in parts[1:]:
            code = code * BASE + p
        at = np.flatnonzero(good)
        yield at, code[at]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, n-gram code and count of every n-gram of normalised texts, by text and code."""
    body = [np.frombuffer(f" {t} \x00".encode(), np.uint8) for t in texts]
    flat = _CODE[np.concatenate(body)] if body else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(body)), [len(b) for b in body])
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(flat), BATCH_CHARS):  # a very long text takes several steps
        piece = flat[start : start + BATCH_CHARS + 3]
        found = [of[start + at[at < BATCH_CHARS]] * BASE**4 + code[at < BATCH_CHARS] for at, code in gram_codes(piece)]
        if found:
            new, n = np.unique(np.concatenate(found), return_counts=True)
            keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    return keys // BASE**4, keys % BASE**4, counts


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of a text column (a longer text is one alone)."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def vectors(texts: DataFrame) -> DataFrame:
    """``texts(..., n)`` with ``codes`` and ``counts`` of its n-grams in place of the normalised text ``n`` (its last column)."""
    keep, at = [c for c in texts.columns if c != "n"], texts.columns.index("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            of, code, count = counted(batch.column(at).to_pylist())
            edges = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (code, count)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *lists], names=[*keep, "codes", "counts"])

    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.mapInArrow(run, f"{schema}, codes array<int>, counts array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of the n-grams of a batch of vectors."""
    codes = batch.column(batch.schema.get_field_index("codes"))
    sizes = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(batch.num_rows), sizes), codes.flatten().to_numpy(), batch.column(batch.schema.get_field_index("counts")).flatten().to_numpy()


def _unit(of: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Weights at length one a row."""
    norm = np.sqrt(np.bincount(of, w * w, n))
    return w / np.where(norm > 0, norm, 1)[of]


@dataclass
class DocumentIndex:
    """``vectors(text_id, m, codes, counts)``, a row a distinct text, ``idf(code, idf)`` and ``texts(cat, text_id, ids)``, all stored."""

    vectors: DataFrame
    idf: DataFrame
    texts: DataFrame
    keep: int

    @classmethod
    def load(cls, spark: SparkSession, path: str, keep: int = 5) -> "DocumentIndex":
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("vectors", "idf", "texts")), keep)


def fit(corpus: DataFrame, doc_id: str, text: str, keep: int = 5, path: str | None = None) -> DocumentIndex:
    """An index of the documents, saved under ``path`` (without one, in the shared folder until the application ends)."""
    spark = corpus.sparkSession
    path = path or new_path(spark, "documents-index")
    rows = corpus_rows({"": (corpus, doc_id, text)})
    vectors(distinct_texts(rows).select("text_id", "m", "n")).write.mode("overwrite").parquet(f"{path}/vectors")
    least_ids(rows, keep).write.mode("overwrite").parquet(f"{path}/texts")
    table = spark.read.parquet(f"{path}/vectors")
    n_docs = table.agg(F.sum("m")).first()[0] or 0
    df = table.select("m", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("m").alias("df"))
    df.select("code", (F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0).alias("idf")).coalesce(1).write.mode("overwrite").parquet(f"{path}/idf")
    return DocumentIndex.load(spark, path, keep)


def idf_table(index: DocumentIndex) -> np.ndarray:
    """The idf of every code, zero for unknown ones: BASE**4 numbers, whatever the corpus."""
    rows = index.idf.toArrow()
    out = np.zeros(BASE**4)
    out[rows["code"].to_numpy()] = rows["idf"].to_numpy()
    return out


def blocks_of(asked: pa.Table, idf: np.ndarray) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """Queries, their n-grams and their weights (n-grams x queries) in blocks of at most ``CELLS`` numbers (one query at least)."""
    out, batch = [], asked.combine_chunks().to_batches()
    for part in batch:
        of, code, count = _flat(part)
        known = idf[code] > 0  # unknown n-grams leave the query before its norm
        of, code, w = of[known], code[known], (count * idf[code])[known]
        w, names = _unit(of, w, part.num_rows), part.column(part.schema.get_field_index("n")).to_pylist()
        start = 0
        while start < len(names):
            step = len(names) - start
            while True:
                a, b = np.searchsorted(of, [start, start + step])
                grams, at = np.unique(code[a:b], return_inverse=True)
                if step == 1 or len(grams) * step <= CELLS:
                    break
                step = max(1, step // 2)
            matrix = np.zeros((len(grams), step))
            matrix[at, of[a:b] - start] = w[a:b]
            out.append((names[start : start + step], grams, matrix))
            start += step
    return out


def found_in(index: DocumentIndex, blocks: list, idf: np.ndarray, k: int) -> DataFrame:
    """``n, text_id, raw``: of each task the ``k`` best documents for each query, ties by ``text_id``."""
    sent = index.vectors.sparkSession.sparkContext.broadcast((blocks, idf))
    kind = index.vectors.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, idf = sent.value
        held: list[tuple] = [None] * len(blocks)  # query, raw, text_id of the best so far
        for whole in batches:
            for start in range(0, whole.num_rows, DOCS):
                batch = whole.slice(start, DOCS)
                of, code, count = _flat(batch)
                w = _unit(of, count * idf[code], batch.num_rows)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for b, (names, grams, matrix) in enumerate(blocks):
                    if not len(grams):
                        continue
                    at = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
                    hit = grams[at] == code
                    x = np.zeros((batch.num_rows, len(grams)))
                    x[of[hit], at[hit]] = w[hit]
                    raw = x @ matrix
                    row, query = np.nonzero(raw > THRESHOLD)
                    new = (query, raw[row, query], ids[row])
                    held[b] = _best(new if held[b] is None else tuple(np.concatenate(z) for z in zip(held[b], new)), k)
        for (names, _, _), best in zip(blocks, held):
            if best is not None and len(best[0]):
                query, raw, ids = best
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(query)), pa.array(ids).cast(batch.schema.field(0).type), pa.array(raw)], names=["n", "text_id", "raw"])

    return index.vectors.select("text_id", "codes", "counts").mapInArrow(run, f"n string, text_id {kind}, raw double")


def _best(rows: tuple, k: int) -> tuple:
    """The first ``k`` of each query by score rounded as ranks are, then ``text_id``."""
    query, raw, ids = rows
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -np.rint(raw * RANK_DIGITS), query))
    query = query[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], raw[order][keep], ids[order][keep]


def top_k(index: DocumentIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """``qid, doc_id, rank, match_score``: the ``k`` best documents for each of ``queries(qid, query)``; the same rows as ``match.top_k`` gives.

    Queries whose n-grams exceed ``PART`` are taken in parts by hash, one pass over the index each.
    """
    if k > index.keep:
        raise ValueError(f"the index keeps {index.keep} ids a text; k is {k}")
    asked = queries.select("qid", F.lit("").alias("cat"), normalise(F.coalesce("query", F.lit(""))).alias("n"))
    distinct = stored(vectors(asked.select(F.col("n").alias("text"), "n").distinct()).withColumnRenamed("text", "n"), "asked")
    size = distinct.agg(F.sum(F.size("codes"))).first()[0] or 0
    parts = -(-size // PART) or 1
    idf = idf_table(index)
    found = None
    for part in range(parts):
        own = distinct.filter(F.pmod(F.xxhash64("n"), F.lit(parts)) == part).toArrow()  # about PART n-grams
        rows = found_in(index, blocks_of(own, idf), idf, k)
        found = rows if found is None else found.unionByName(rows)
    ranked = best_rows(found.select(F.lit("").alias("cat"), "n", "text_id", "raw"), index.texts, k)
    return asked.join(ranked, ["cat", "n"]).select("qid", "doc_id", "rank", round3(F.col("raw")).alias("match_score"))
