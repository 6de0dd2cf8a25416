"""Embedding near-dedup: p-stable (Euclidean) hashing of normalised vectors, then exact cosine checks.

Equal vectors of a label are one vector with a number of copies. Shuffled by bucket are row numbers
alone; buckets of the same members are searched once, and a vector travels only to the cells in which
it meets another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.grouping import block_pairs, components, hot_from, in_cells, local_roots, meet
from quillmatch.llm.shared import in_tasks, written

TABLES = 14  #: Hash tables. Two unit vectors of cosine 0.98 (0.2 apart) share one of them with p > 0.99.
QUANTA = 6  #: Quantised projections joined in a table's bucket.
WIDTH = 1.0  #: Width of a quantum.
BLOCK = 2048  #: Vectors of one bucket that one task compares with as many others.
SEED = 20


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` (double precision) at length one, and which of them are finite and not zero.

    A row is scaled by its largest component first, so no square overflows or vanishes.
    """
    with np.errstate(all="ignore"):
        largest = np.abs(x).max(axis=1, initial=0.0)
        good = np.isfinite(largest) & (largest > 0)
        x = np.where(good[:, None], x / np.where(good, largest, 1)[:, None], 0)
        norm = np.sqrt((x * x).sum(axis=1))
        return x / np.where(good, norm, 1)[:, None], good


def matrix(vectors: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    """The vectors of ``rows``, all of ``width`` components, as doubles; a null component is not finite."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.fromiter((0 if n is None else n for n in vectors.value_lengths().to_pylist()), np.int64, len(vectors))
    start = np.cumsum(sizes) - sizes
    return flat[start[rows][:, None] + np.arange(width)]


def bucketed(vectors: DataFrame, tables: int, quanta: int, width: float, seed: int) -> DataFrame:
    """``row_id, slots`` of ``vectors(row_id, label, embedding)``: one hashed bucket a table; vectors that link with nothing are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            vectors = batch.column(2)
            widths = np.array([0 if n is None else n for n in vectors.value_lengths().to_pylist()])
            ids, slots = [], []
            for d in np.unique(widths[widths > 0]).tolist():
                if d not in planes:
                    rng = np.random.default_rng([seed, d])
                    planes[d] = (rng.standard_normal((d, tables * quanta)), rng.uniform(0, width, tables * quanta), rng.integers(1, 2**62, quanta) * 2 + 1)
                project, shift, mix = planes[d]
                rows = np.flatnonzero(widths == d)
                x, good = units(matrix(vectors, rows, d))
                cells = np.floor((x[good] @ project + shift) / width).astype(np.int64).reshape(-1, tables, quanta)
                with np.errstate(over="ignore"):
                    keys = (cells * mix).sum(axis=2) ^ np.int64(d)
                ids.append(rows[good])
                slots.append(keys)
            if ids:
                take = pa.array(np.concatenate(ids))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(slots).ravel()), tables).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), lists], names=["row_id", "label", "buckets"])

    kind = vectors.schema["label"].dataType.simpleString()
    rows = in_tasks(vectors.select("row_id", "label", "embedding"), run, f"row_id bigint, label {kind}, buckets array<bigint>")
    return rows.select("row_id", F.transform("buckets", lambda b, table: F.xxhash64("label", table, b)).alias("slots"))


class Cells:
    """What ``work`` needs of a run of cells, as numpy arrays."""

    def __init__(self, table: pa.Table):
        column = lambda c: table[c].combine_chunks()
        self.ids, self.copies = column("row_id").to_numpy(), column("copies").to_numpy()
        self.side, self.slot = column("side").to_numpy() == 1, column("slot").to_numpy()
        self.vectors, self.labels = column("embedding"), column("label").dictionary_encode().indices.to_numpy()
        slots = column("slots")
        self.of = np.repeat(np.arange(len(slots)), slots.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        self.slots = slots.flatten().to_numpy()

    def earlier(self, start: int, end: int) -> np.ndarray:
        """Which rows of a cell are in which of the buckets, before the cell's own, that two of its rows share."""
        a, b = np.searchsorted(self.of, [start, end])
        of, slots = self.of[a:b] - start, self.slots[a:b]
        before = slots < self.slot[start + of]
        of, slots = of[before], slots[before]
        _, at, n = np.unique(slots, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(n > 1)
        out = np.zeros((end - start, len(shared)), np.float32)
        some = n[at] > 1
        out[of[some], np.searchsorted(shared, at[some])] = 1
        return out


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, quanta: int = QUANTA, width: float = WIDTH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Two vectors link when their labels are equal and not null, their dimensions agree and their
    cosine in double precision is at least ``least``; pairs are searched among those that share a
    bucket of any table. A pair is counted in the first bucket it shares, so none counts twice.
    ``component_id`` is the smallest ``vec_id`` reachable, ``kept`` says it is the row's own.
    Null, empty, zero and non-finite vectors and null labels link with nothing; repeated rows are
    vectors of their own and link with each other; further columns are ignored; an empty table gives an
    empty result.
    """
    same = [F.xxhash64(F.lit("a"), F.col("label").isNull(), "label", "embedding").alias("v_a"), F.xxhash64(F.lit("b"), "embedding", "label", F.size("embedding")).alias("v_b")]
    rows = vectors.select("vec_id", *same, "label", "embedding")
    distinct = rows.groupBy("v_a", "v_b").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first(F.struct("label", "embedding")).alias("v"))
    distinct = distinct.select("v_a", "v_b", "copies", "least_id", "v.label", "v.embedding", F.monotonically_increasing_id().alias("row_id"))
    distinct = written(distinct, "lsh-rows")
    held = written(bucketed(distinct.filter("label is not null and embedding is not null"), tables, quanta, width, seed), "lsh-slots")
    slots = held.select("row_id", F.explode("slots").alias("slot"))
    mark = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "row_id"))
    sizes = slots.groupBy("slot").agg(F.count("*").alias("n"), mark("a").alias("x"), mark("b").alias("y")).filter("n > 1")
    once = sizes.groupBy("n", "x", "y").agg(F.min("slot").alias("slot")).select("slot")
    met = written(slots.join(once, "slot", "left_semi"), "lsh-met")
    members = met.groupBy("row_id").agg(F.sort_array(F.collect_list("slot")).alias("slots")).join(distinct.select("row_id", "label", "embedding", "copies"), "row_id")

    def work(cells: Cells, start: int, end: int) -> pa.RecordBatch | None:
        ids, side = cells.ids[start:end], cells.side[start:end]
        own = cells.vectors.slice(start, end - start)
        sizes, before = np.array(own.value_lengths()), cells.earlier(start, end)
        found_i, found_j = [], []
        # Labels and dimensions differ within a cell only where two slots' hashes collide.
        for d in np.unique(sizes).tolist():
            rows_d = np.flatnonzero(sizes == d)
            x, _ = units(matrix(own, rows_d, d))
            left = np.flatnonzero(~side[rows_d])
            right = np.flatnonzero(side[rows_d]) if side.any() else left
            for at in range(0, len(left), 512):
                part = left[at : at + 512]
                near = x[part] @ x[right].T >= least
                for k in range(0, before.shape[1], 1024):
                    near &= before[rows_d[part], k : k + 1024] @ before[rows_d[right], k : k + 1024].T == 0
                a, b = np.nonzero(near)
                i, j = rows_d[part[a]], rows_d[right[b]]
                keep = (i != j) & (cells.labels[start + i] == cells.labels[start + j]) & (cells.slot[start + i] == cells.slot[start + j])
                if not side.any():
                    keep &= i < j
                found_i.append(i[keep])
                found_j.append(j[keep])
        i, j = np.concatenate([np.zeros(0, np.int64), *found_i]), np.concatenate([np.zeros(0, np.int64), *found_j])
        if not len(i):
            return None
        root = local_roots(len(ids), i, j)
        copies = cells.copies[start:end]
        count = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some].astype(np.int64)), pa.array(ids[root[some]])], names=["row_id", "n", "root"])

    dealt = block_pairs(met, "slot", "row_id", block).join(members, "row_id")
    found = written(in_cells(dealt, work, "row_id bigint, n bigint, root bigint", ready=Cells), "lsh-links")
    linked = components(found.select(F.col("row_id").alias("a"), F.col("root").alias("b")), "lsh")
    counts = found.groupBy("row_id").agg(F.sum("n").alias("n_others"))
    good = held.select("row_id", F.lit(True).alias("good"))
    named = distinct.select("v_a", "v_b", "copies", "least_id", "row_id").join(good, "row_id", "left").join(counts, "row_id", "left")
    named = written(named.join(linked, F.col("row_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "row_id")), "lsh-named")
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component"), F.count("*").alias("n"))
    many = hot_from(rows.count())
    links = F.when(F.col("good"), F.coalesce("n_others", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("bigint")
    table = meet(named, smallest, "root", many).select("v_a", "v_b", "good", "component", links.alias("n_links"), F.col("copies").alias("n"))
    out = meet(rows.select("vec_id", "v_a", "v_b"), table, ["v_a", "v_b"], many)
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", "n_links", component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
