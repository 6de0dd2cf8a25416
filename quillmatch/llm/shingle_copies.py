"""Near copies by the Jaccard similarity of word shingles: SimHash candidates in vantage-point shards, verified exactly.

At a similarity of 0.8 about 15 % of the bits of SimHash fingerprints differ, 10 of 64 and up to 20 or so:
a radius at which vantage points on all bits cut nothing off. So fingerprints have 512 bits, dealt into
blocks, and each block has a vantage-point tree of its own with a small radius: its upper levels are the
shards, with guests beyond a node's middle as in ``simhash_vptree``, and a tree within the shard finds the
pairs near in the block, which are compared on ``CHECKED`` words. Their components are groups of
candidates; within a group the shingle sets are compared exactly unless they are linked already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.grouping import block_pairs, components, in_cells
from quillmatch.llm.shared import as_row, in_tasks, one_of_repeats, row_key, same_key, written
from quillmatch.llm.simhash_vptree import LEVELS, SAMPLE, in_shards, tree_links, tree_pairs, vantage_points

LEAST = 0.8  #: Similarity from which two texts are copies.
SHINGLE = 5  #: Words of a shingle.
WORDS = 8  #: Of 64 bits in a fingerprint.
WIDTH = 16  #: Bits of a block; each block has a tree.
REACH = 1  #: Bits that may differ in a block: a pair at 0.8 (15 % of the bits) is that near in no block with a probability of 0.00003.
CHECKED = 3  #: Words that pairs of a shard are compared on.
FAR = 54  #: Bits of these that may differ; five standard deviations beyond the mean at 0.8, six below that of unrelated sets.
SHARD = 131_072  #: Fingerprints that are at home in one shard, at most, about.
FEW, SPREAD = 4096, 3  #: Fingerprints from which there are shards, and levels of them however few fingerprints there are.
CELL = 1_048_576  #: Fingerprints of one shard that one task compares with as many others; a usual shard, guests included, is below it.
RADIUS = 24  #: Bits of the first word, within a group; five standard deviations beyond the mean at 0.8.
BLOCK = 1024  #: Texts of one group that one task compares with as many others.

_TREES = WORDS * 64 // WIDTH


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of words, each as often as it comes; fewer words: one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    span = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - span].tolist(), ends[span:].tolist())], np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles: SimHash bits of their hashes, then of these mixed anew for each further word."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(own), 255):
        part = own[at : at + 255, None] + np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = part[:, 1:]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        part[:, 1:] = z ^ (z >> np.uint64(31))
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own), bitorder="little").view(np.uint64)


def prints(docs: DataFrame) -> DataFrame:
    """``rk_*, uid, n, words`` of ``docs(doc_id, text)``: a 64-bit hash, the size and the fingerprint of the set of shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, sizes, words = [], [], [np.zeros(0, np.uint64)]
            for text in batch.column(3).to_pylist():
                own = np.unique(shingles(text))
                uid.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
                sizes.append(len(own))
                words.append(signature(own))
            lists = pa.ListArray.from_arrays(np.arange(len(uid) + 1, dtype=np.int32) * WORDS, np.concatenate(words).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(uid, pa.int64()), pa.array(sizes, pa.int64()), lists],
                names=["rk_id", "rk_a", "rk_b", "uid", "n", "words"],
            )

    return in_tasks(docs.select(*row_key(), "text"), run, f"rk_id {kind}, rk_a bigint, rk_b bigint, uid bigint, n bigint, words array<bigint>", text=3)


def block_of(words: np.ndarray, tree: int) -> np.ndarray:
    """The bits of fingerprints (rows of words) that a tree is over."""
    word, at = divmod(tree * WIDTH, 64)
    return (words[:, word] >> np.uint64(at)) & np.uint64((1 << WIDTH) - 1)


def sharded(sets: DataFrame, shard: int, cell: int) -> DataFrame:
    """``cell, tag, uid, w0..`` of ``sets(uid, words)``: each set in the shards of each tree, large shards in cells of two blocks.

    ``tag`` holds the block's value, whether the set is a guest there and its side of the cell.
    """
    n = sets.count()
    deep = lambda size: max(0, int(np.ceil(np.log2(max(n, 1) / size))))
    levels = min(LEVELS, deep(min(FEW, shard)), max(SPREAD, deep(shard)))
    chosen = sets.filter(F.pmod(F.xxhash64(F.lit("sample"), "uid"), F.lit(1_000_000)) < int(1e6 * min(1.0, SAMPLE / max(n, 1)))) if levels else sets.limit(0)
    some = np.array(sorted(r["words"] for r in chosen.select("words").collect()), np.int64).reshape(-1, WORDS).view(np.uint64)  # about ``SAMPLE``
    trees = [vantage_points(block_of(some, k), WIDTH, levels, REACH, k) for k in range(_TREES)]

    def placed(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words = batch.column(1).flatten().to_numpy().reshape(-1, WORDS)
        value = block_of(words.view(np.uint64), k)
        at, number, guest = in_shards(value, *trees[k], REACH)
        return words, value.astype(np.int64), at, (k << LEVELS) + number, guest

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(_TREES):
                of, many = np.unique(placed(batch, k)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(many)], names=["shard", "n"])

    blocks: dict[int, int] = {}
    if n > cell:  # otherwise no shard is larger
        large = in_tasks(sets, sizes, "shard bigint, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).filter(F.col("n") > cell)
        blocks = {r["shard"]: -(-r["n"] // cell) for r in large.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for k in range(_TREES):
                words, value, at, number, guest = placed(batch, k)
                base, tag = number << 32, value[at] * 4 + guest * 2
                parts = [(np.flatnonzero(~np.isin(number, list(blocks))), 0, 0)]
                for large, many in blocks.items():
                    own = np.flatnonzero(number == large)
                    block = (uid[at[own]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % many
                    parts += [(own, (np.minimum(block, j) << 16) + np.maximum(block, j), (j < block).astype(np.int64)) for j in range(many)]
                for own, pair, side in parts:
                    columns = [base[own] + pair, tag[own] + side, uid[at[own]], *words[at[own], :CHECKED].T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    names = ["cell", "tag", "uid", *(f"w{i}" for i in range(CHECKED))]
    return in_tasks(sets, run, ", ".join(f"{c} bigint" for c in names))


def candidates(one: DataFrame, least: float = LEAST, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """``node, root``: components of the sets of ``one(uid, at)`` over all pairs near in some block and on the checked words."""
    # A smaller set has a similarity of less with any other than itself.
    sets = one.filter(F.col("at.n") >= least * (F.col("at.n") + 1)).select("uid", "at.words")

    def work(table: pa.Table, start: int, end: int) -> pa.RecordBatch | None:
        own = table.slice(start, end - start)
        uid, tag = own["uid"].to_numpy(), own["tag"].to_numpy()
        full = np.stack([own[f"w{i}"].to_numpy() for i in range(CHECKED)], axis=1).view(np.uint64)
        side, guest = (tag & 1) == 1, (tag & 2) == 2
        p, q = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() else (np.arange(len(uid)), np.flatnonzero(~guest))
        root = tree_links((tag >> 2).astype(np.uint16), full, p, q, ~guest, REACH, FAR)
        leaf = np.flatnonzero(root != np.arange(len(uid)))
        return pa.RecordBatch.from_arrays([pa.array(uid[leaf]), pa.array(uid[root[leaf]])], names=["a", "b"]) if len(leaf) else None

    return components(in_cells(sharded(sets, shard, cell), work, "a bigint, b bigint"), "copies-candidates")


def links(docs: DataFrame, one: DataFrame, least: float = LEAST) -> DataFrame:
    """Links ``a - b`` that span the components of all candidate pairs of ``one(uid, at)`` with a similarity of ``least``."""
    near = candidates(one, least)
    kept = written(one.join(near, one["uid"] == near["node"]).select("uid", F.element_at("at.words", 1).alias("fp"), F.col("root").alias("near")), "copies-near")
    asked = one.join(kept, "uid", "left_semi").select("uid", "at.rk_a", "at.rk_b")
    whole = docs.select(*row_key(), "text")
    texts = written(whole.join(asked, same_key(whole, asked)).select("uid", "text").dropDuplicates(["uid"]), "copies-texts")
    met = block_pairs(kept, "near", "uid", BLOCK).select("cell", "side", "uid", "fp").join(texts, "uid")

    def work(table: pa.Table, start: int, end: int) -> pa.RecordBatch | None:
        own = table.slice(start, end - start)
        uid, fp = own["uid"].to_numpy(), own["fp"].to_numpy().view(np.uint64)
        side = own["side"].to_numpy() == 1
        p, q = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() else (np.arange(len(uid)),) * 2
        hit_q, hit_p = tree_pairs(fp[p], fp[q], RADIUS)
        i, j = q[hit_q], p[hit_p]
        some = (i > j) if not side.any() else np.ones(len(i), bool)
        i, j = i[some], j[some]
        close = np.argsort(np.bitwise_count(fp[i] ^ fp[j]), kind="stable")
        sets: dict[int, np.ndarray] = {}
        root = list(range(len(uid)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        def get(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = np.unique(shingles(own["text"][k].as_py()))
            return sets[k]

        found = []
        for a, b in zip(i[close].tolist(), j[close].tolist()):
            if (x := find(a)) != (y := find(b)) and similar(get(a), get(b), least):
                root[x] = y
                found.append((a, b))
        if not found:
            return None
        a, b = np.array(found).T
        return pa.RecordBatch.from_arrays([pa.array(uid[a]), pa.array(uid[b])], names=["a", "b"])

    return in_cells(met, work, "a bigint, b bigint")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets have a Jaccard similarity of ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def keep_first_similar(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each component of similar texts left: the one of the smallest ``doc_id``.

    Texts are linked at a similarity of ``least`` or more of their sets of five-word shingles; those
    without a word (null and empty texts among them) are alike. Null ids come last; ties (repeated ids)
    go by the hash of id and text; rows that repeat id and text are one document, of which the first by
    its other columns stays; columns of any other name pass through; an empty table gives an empty result.
    """
    at = F.struct(F.col("rk_id").isNull().alias("no_id"), "rk_id", "rk_a", "rk_b", "n", "words")
    one = written(prints(docs).groupBy("uid").agg(F.min(at).alias("at")), "copies-sets")
    linked = components(links(docs, one, least), "copies")
    named = one.join(linked, one["uid"] == linked["node"], "left").select("at", F.coalesce("root", "uid").alias("root"))
    key = named.select("root", F.struct("at.no_id", "at.rk_id", "at.rk_a", "at.rk_b").alias("at"))
    stay = key.groupBy("root").agg(F.min("at").alias("first")).select("first.rk_a", "first.rk_b")
    whole = docs.select(as_row(docs), *row_key())
    kept = whole.join(stay, same_key(whole, stay), "left_semi")
    return one_of_repeats(kept, docs.columns)
