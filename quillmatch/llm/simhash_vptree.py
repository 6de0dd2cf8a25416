"""SimHash near-dedup: fingerprints linked by exact Hamming search over vantage-point shards.

A tree of vantage points partitions the fingerprints by Hamming distance: those within a node's middle
distance go to its inner branch, the others to the outer one, and who lies within the radius beyond
the middle is a guest in the inner branch as well (boundary-overlapping shards). The leaves are the
shards; in each a vantage-point tree prunes branches by the triangle bounds, vectorised over all
queries at a node, and what is left is compared bit by bit. Shards emit links that span their
components, never all pairs.

On all 64 bits a tree of radius 4 prunes next to nothing, as unrelated fingerprints lie 32 bits apart,
give or take 4, from any vantage point. Two fingerprints within 4 bits are within one bit in one of
three blocks of the bits, so each block has a tree of its own with radius 1, and a pair found there is
checked on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.grouping import block_pairs, components, hot_from, in_cells, local_roots, meet
from quillmatch.llm.shared import as_row, in_tasks, one_of_repeats, row_key, same_key, written

BLOCKS = 3  #: Blocks of bits with a tree each; a pair within the radius is within a third of it in one of them.
SHARD = 8192  #: Fingerprints that are at home in one shard, about.
SAMPLE = 16_384  #: Distinct fingerprints that vantage points are chosen on, about (of all, every one is in the shards).
LEVELS = 18  #: Of the tree above the shards, at most; a shard of more is dealt out in blocks.
LEAF = 64  #: Points below which a branch is compared directly.
BLOCK = 131_072  #: Fingerprints of one shard that one task compares with as many others; a usual shard, guests included, is below it.
HELD = 200_000  #: Links that a shard holds before it reduces them to those that span.


def simhash(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash over shingles of words; text without a word: 0; fewer words: one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    span = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - span].tolist(), ends[span:].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``docs(doc_id, text, rk_*)`` with ``fp`` (the fingerprint as a signed long) in place of the text."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            fps = np.array([simhash(t, shingle) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps)], names=[*kept, "fp"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return in_tasks(docs, run, f"{schema}, fp bigint", text=docs.columns.index("text"))


def tree_pairs(points: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices ``(q, p)`` of all pairs within ``radius`` bits, found by a vantage-point tree over ``points``."""
    found_q: list[np.ndarray] = []
    found_p: list[np.ndarray] = []
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            vantage = points[p[len(p) // 2]]
            dp = np.bitwise_count(points[p] ^ vantage)
            mid = int(np.median(dp))
            inner = dp <= mid
            if not inner.all():
                dq = np.bitwise_count(queries[q] ^ vantage).astype(np.int64)
                todo.append((p[inner], q[dq <= mid + radius]))
                todo.append((p[~inner], q[dq > mid - radius]))
                continue
        for at in range(0, len(q), 4096):
            some = q[at : at + 4096]
            for pt in range(0, len(p), 256):
                hit_q, hit_p = np.nonzero(np.bitwise_count(queries[some][:, None] ^ points[p[pt : pt + 256]][None, :]) <= radius)
                found_q.append(some[hit_q])
                found_p.append(p[pt : pt + 256][hit_p])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_q]), np.concatenate([empty, *found_p])


def block_bounds(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """First bit and width of each block of the 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:])]


def block_of(fp: np.ndarray, lo: int, width: int) -> np.ndarray:
    return (fp >> np.uint64(lo)) & np.uint64((1 << width) - 1)


def vantage_points(sample: np.ndarray, width: int, levels: int, reach: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage point and middle distance of each node of a tree of ``levels`` (a heap: the root is 0).

    Of a few members of the sample in a node the one with the fewest others just beyond its middle
    distance becomes the vantage point; where the sample has run out, any value and half the width do.
    """
    r = np.random.default_rng([seed, width])
    nodes = (1 << levels) - 1
    vantage = r.integers(0, 1 << width, nodes, np.uint64)
    middle = np.full(nodes, width // 2, np.int64)
    members = [sample]
    for node in range(nodes):
        own = members[node]
        if len(own) >= 32:
            options = own[r.integers(0, len(own), 4)]
            apart = np.bitwise_count(own[None, :] ^ options[:, None]).astype(np.int64)
            mids = np.median(apart, axis=1).astype(np.int64)
            crowd = ((apart > mids[:, None]) & (apart <= mids[:, None] + reach)).sum(axis=1) + np.abs(2 * (apart <= mids[:, None]).sum(axis=1) - len(own))
            best = int(np.argmin(crowd))
            vantage[node], middle[node] = options[best], mids[best]
        inner = np.bitwise_count(own ^ vantage[node]) <= middle[node]
        members += [own[inner], own[~inner]]
        members[node] = own[:0]
    return vantage, middle


def in_shards(value: np.ndarray, vantage: np.ndarray, middle: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(which value, shard, is it a guest there)``: every value at home in one shard, and a guest wherever one within ``reach`` may be at home."""
    at, node, guest = np.arange(len(value)), np.zeros(len(value), np.int64), np.zeros(len(value), bool)
    for _ in range(len(vantage).bit_length()):
        d = np.bitwise_count(value[at] ^ vantage[node]).astype(np.int64)
        mid = middle[node]
        inner, outer = d <= mid + reach, np.where(guest, d > mid - reach, d > mid)
        at, node, guest = np.r_[at[inner], at[outer]], np.r_[2 * node[inner] + 1, 2 * node[outer] + 2], np.r_[(guest | (d > mid))[inner], guest[outer]]
    return at, node - len(vantage), guest


def sharded(distinct: DataFrame, radius: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``fp, part, shard, guest`` of ``distinct(fp)``: each fingerprint in the shards of each block's tree."""
    n = distinct.count()
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(n, 1) / shard)))))
    chosen = distinct.filter(F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(1_000_000)) < int(1e6 * min(1.0, sample / max(n, 1)))) if levels else distinct.limit(0)
    some = np.sort(np.array([r["fp"] for r in chosen.collect()], np.int64)).view(np.uint64)  # about ``sample``
    reach = radius // BLOCKS
    bounds = block_bounds()
    trees = [vantage_points(block_of(some, lo, width), width, levels, reach, k) for k, (lo, width) in enumerate(bounds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k, (lo, width) in enumerate(bounds):
                at, number, guest = in_shards(block_of(fp.view(np.uint64), lo, width), *trees[k], reach)
                columns = [pa.array(fp[at]), pa.array(np.full(len(at), k, np.int32)), pa.array(number), pa.array(guest)]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "part", "number", "guest"])

    rows = in_tasks(distinct.select("fp"), run, "fp bigint, part int, number bigint, guest boolean")
    return rows.select("fp", "part", "guest", F.xxhash64("part", "number").alias("shard"))


def tree_links(block: np.ndarray, full: np.ndarray, p: np.ndarray, q: np.ndarray, home: np.ndarray, reach: int, radius: int) -> np.ndarray:
    """The smallest index that each fingerprint of a shard reaches over links between ``p`` and ``q`` of which one is at home.

    A vantage-point tree over the block values of ``p`` is asked for all of ``q`` at once. Of fingerprints
    of several words (rows of ``full``) those within ``reach`` in the block alone are compared.
    """
    root = np.arange(len(full))
    n, held = len(full), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    count = 0

    def reduced() -> np.ndarray:
        return local_roots(n, np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held]))

    todo = [(p, q)]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            vantage = block[p[len(p) // 2]]
            dp = np.bitwise_count(block[p] ^ vantage).astype(np.int64)
            mid = int(np.median(dp))
            inner = dp <= mid
            if inner.all():
                mid = int(dp.min())
                inner = dp <= mid
            if not inner.all():
                dq = np.bitwise_count(block[q] ^ vantage).astype(np.int64)
                todo += [(p[inner], q[dq <= mid + reach]), (p[~inner], q[dq > mid - reach])]
                continue
        for at in range(0, len(q), 4096):
            some = q[at : at + 4096]
            for pt in range(0, len(p), 256):
                own = p[pt : pt + 256]
                if full.ndim == 1:
                    i, j = np.nonzero(np.bitwise_count(full[some][:, None] ^ full[own][None, :]) <= radius)
                    i, j = some[i], own[j]
                else:
                    i, j = np.nonzero(np.bitwise_count(block[some][:, None] ^ block[own][None, :]) <= reach)
                    i, j = some[i], own[j]
                    apart = root[i] != root[j]
                    i, j = i[apart], j[apart]
                    near = np.bitwise_count(full[i] ^ full[j]).sum(axis=1, dtype=np.int64) <= radius
                    i, j = i[near], j[near]
                keep = (i != j) & (home[i] | home[j])
                held.append((i[keep], j[keep]))
                count += int(keep.sum())
                if count > HELD:
                    root = reduced()
                    some_linked = np.flatnonzero(root != np.arange(n))
                    held, count = [(some_linked, root[some_linked])], 0
    return reduced()


def links(fps: DataFrame, radius: int = 4, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Links ``a - b`` (long) that span the same components as all pairs of distinct ``fp`` within ``radius``; ``fps`` is a written table."""
    shards = written(sharded(fps, radius, shard), "simhash-shards")
    bounds, reach = block_bounds(), radius // BLOCKS

    def work(table: pa.Table, start: int, end: int):
        own = table.slice(start, end - start)
        fp, guest = own["fp"].to_numpy(), own["guest"].to_numpy()
        full, side = fp.view(np.uint64), own["side"].to_numpy() == 1
        lo, width = bounds[own["part"][0].as_py()]
        p, q = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() else (np.arange(len(fp)), np.flatnonzero(~guest))
        root = tree_links(block_of(full, lo, width), full, p, q, ~guest, reach, radius)
        leaf = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[leaf]), pa.array(fp[root[leaf]])], names=["a", "b"]) if len(leaf) else None

    return in_cells(block_pairs(shards, "shard", "fp", block), work, "a bigint, b bigint")


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``fp, root``: for every distinct fingerprint the one that names its component."""
    distinct = written(prints.select("fp").distinct(), "simhash-distinct")
    linked = components(links(distinct, radius), "simhash")
    return distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Links any two rows whose fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest ``doc_id`` reachable. Null and empty texts (and those of white space) have fingerprint
    zero and link with each other like any other; repeated rows each get a row; a null ``doc_id``
    takes part but is never the smallest; further columns are ignored; an empty table gives an empty
    result.
    """
    prints = written(fingerprints(docs.select("doc_id", "text"), shingle), "simhash-prints")
    many = hot_from(prints.count())
    counted = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    least = written(counted.join(classes(prints, radius), "fp"), "simhash-classes")
    smallest = least.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    of_print = meet(least.select("fp", "root", F.col("n").alias("n_rows")), smallest, "root", many).select("fp", "component_id", F.col("n_rows").alias("n"))
    named = meet(prints, of_print, "fp", many)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate component left: the one of the smallest ``doc_id``.

    Null ids come last; ties (repeated ids) go by the hash of id and text; rows that repeat id and text
    are one document, of which the first by its other columns stays; null and empty texts are alike;
    columns of any other name pass through; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs.select("text", *row_key()), shingle), "simhash-prints")
    named = prints.join(classes(prints, radius), "fp")
    first = F.min(F.struct(F.col("rk_id").isNull(), "rk_id", "rk_a", "rk_b")).alias("first")
    stay = named.groupBy("root").agg(first).select("first.rk_a", "first.rk_b")
    whole = docs.select(as_row(docs), *row_key())
    kept = whole.join(stay, same_key(whole, stay), "left_semi")
    return one_of_repeats(kept, docs.columns)
