"""Pairs within groups whose size nobody bounds: split into blocks, met block by block, linked locally."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.shared import cache_of, discard, written

HOT = 1000  #: A key with over one in so many rows is hot; so there are fewer hot keys than this, at any size.


def block_pairs(rows: DataFrame, group: str, uid: str, block: int) -> DataFrame:
    """Rows of groups of two or more, dealt so that every two of a group meet in exactly one cell.

    A group of up to ``block`` rows is one cell. A larger one is cut by a hash of ``uid`` into
    blocks, and each two blocks (and each block with itself) are a cell of their own, so no task
    ever holds more than about two blocks of one group. Adds ``cell`` (long) and ``side`` (0: first
    block, 1: second block of a cell of two blocks; cells of one block have side 0 only).

    Hot groups are split before rows meet their group's size: their sizes, fewer than ``HOT``, are
    broadcast, and each of their blocks is a join key of its own. ``rows`` should be a written table,
    as it is read more than once.
    """
    least = max(block, rows.count() // HOT)  # of a hot group
    sizes = rows.groupBy(group).agg(F.count("*").alias("n_group")).filter("n_group > 1")
    hot = sizes.filter(F.col("n_group") > least).select(F.col(group).alias("hot_group"), _blocks("n_group", block).alias("hot_blocks"))
    salted = rows.join(F.broadcast(hot), F.col(group) == F.col("hot_group"), "left").drop("hot_group")
    salted = salted.withColumn("salt", F.when(F.col("hot_blocks").isNotNull(), F.pmod(F.xxhash64(F.lit("block"), uid), F.col("hot_blocks"))).otherwise(0).cast("int"))
    last = F.when(F.col("n_group") > least, _blocks("n_group", block) - 1).otherwise(0)
    salts = sizes.select(F.col(group).alias("s_group"), "n_group", F.explode(F.sequence(F.lit(0), last)).alias("s_salt"))
    met = salted.join(salts, (F.col(group) == F.col("s_group")) & (F.col("salt") == F.col("s_salt"))).withColumn("n_blocks", _blocks("n_group", block))
    met = met.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), uid), F.col("n_blocks")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda j: F.struct(F.least("own", j).alias("lo"), F.greatest("own", j).alias("hi"), (j < F.col("own")).cast("int").alias("side")),
    )
    met = met.withColumn("meet", F.explode(others))
    cell = F.xxhash64(F.col(group), F.col("meet.lo"), F.col("meet.hi"))
    return met.withColumn("cell", cell).withColumn("side", F.col("meet.side")).select(*rows.columns, "cell", "side")


def _blocks(n: str, block: int):
    return F.ceil(F.col(n) / F.lit(block)).cast("int")


def in_cells(rows: DataFrame, work: Callable, schema: str, finish: Callable[[], pa.RecordBatch | None] | None = None, ready: Callable[[pa.Table], object] = lambda table: table) -> DataFrame:
    """Brings the rows of a cell together and hands each cell to ``work(ready(table), start, end)``.

    Cells are runs of equal ``cell`` in sorted Arrow batches, so tiny cells cost no Python call of
    Spark's own each and only one cell beyond the present batch is held. What ``work`` keeps back to do
    at once for several cells, ``finish()`` returns at the end of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of(None)
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            cells = held["cell"].to_numpy()
            last = int(np.searchsorted(cells, cells[-1]))
            if last:
                yield from _each(ready(held.slice(0, last).combine_chunks()), cells[:last], work)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from _each(ready(held.combine_chunks()), held["cell"].to_numpy(), work)
        if finish is not None and (rest := finish()) is not None:
            yield rest

    dealt = rows.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, schema)


def _each(table, cells: np.ndarray, work) -> Iterator[pa.RecordBatch]:
    edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    for start, end in zip(edges[:-1], edges[1:]):
        if end - start > 1:
            out = work(table, int(start), int(end))
            if out is not None:
                yield out


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` items reaches over the links ``i[k] - j[k]``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def meet(rows: DataFrame, table: DataFrame, key: str | list[str], many: int) -> DataFrame:
    """``rows`` joined with ``table(key, n, ...)``, which has one row a key (without nulls) and in ``n`` how many rows have it.

    Keys of over ``many`` rows (of which ``many`` is to be a fixed share, so that they are few) meet their
    rows by broadcast, the others in a shuffle: no hot key's rows are all in one task.
    """
    hot = table.filter(F.col("n") > many).drop("n")
    far = rows.join(F.broadcast(hot), key)
    near = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop("n"), key)
    return far.unionByName(near)


def hot_from(n: int) -> int:
    """The number of rows of ``n`` from which a key is hot; fewer than ``HOT`` keys can be."""
    return max(10_000, n // HOT)


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of the links ``a - b`` (long): ``node, root`` for every node that has a link.

    ``root`` is the smallest node reachable. Alternates the two star steps (join each node's larger
    neighbours to its least one, then its smaller ones) until nothing changes; every step is a join
    and a pre-aggregated minimum, so a component may hold any share of the nodes. Each round is
    written to the shared folder and takes the place of the one before.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-links")
    seen, n = None, now.count()
    while True:
        many = hot_from(2 * n)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = meet(both, low, "u", many).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"{label}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = meet(large, least, "u", many).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}-round")
        discard(now, large)
        now = new
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen:
            break
        seen, n = mark, mark["n"]
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
