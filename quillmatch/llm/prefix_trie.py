"""The prefix trie of conversations: MSD radix partitioning on Spark down to small buckets, multikey quicksort within them.

Turns become ids of a dictionary, equal conversations one sequence with a weight. A bucket is a node of the
trie with all sequences below it. Each round takes every large bucket along the turns that all its
sequences share (a chain of nodes, found by one aggregation, however long) and deals the rest by the
next turn; a bucket of few turns is finished in one task. Sums over subtrees come back up the same rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.llm.grouping import hot_from, meet
from quillmatch.llm.shared import WORD, cache_of, discard, written

TURNS = 1000  #: Turn numbers (and depths of a chain) that one window holds together.
LOCAL = 50_000  #: Turns of a bucket that one task finishes; larger buckets are dealt by one more turn.
GROUP, SHARED = 20, 4  #: A conversation takes its first turns, fewer than ``SHARED``, from the first of its ``GROUP``.
TEXT = 1 << 20  #: Characters of ids that are hashed at once.
NOTHING = hashlib.sha256(b"").hexdigest()


def hashed(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, ha, hb, tokens, block`` of every turn: a 128-bit hash of role and text, and the words of the text.

    Blocks hold ``TURNS`` turn numbers, or one of 4,096 hash ranges of the rows without one.
    """
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.select("conv", "turn", "role", F.xxhash64(F.lit("a"), "role", "text").alias("ha"), F.xxhash64(F.lit("b"), "text", "role").alias("hb"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("tokens"))
    lost = F.shiftright("hb", 52) - F.lit(1 << 62)
    return rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / F.lit(TURNS)), lost))


def families(blocks: DataFrame) -> DataFrame:
    """``conv, h, leader, n_head`` of every conversation in ``blocks(conv, block, n)``: how many first turns it drops, whose it takes and how many those are."""
    own = blocks.groupBy("conv").agg(F.sum("n").alias("own"))
    own = own.withColumn("h", F.crc32(F.col("conv").cast("string")) % SHARED).withColumn("leader", F.col("conv") - F.col("conv") % GROUP)
    leaders = own.filter("conv = leader").select("leader", F.col("own").alias("has"))
    return own.join(leaders, "leader", "left").select("conv", "h", "leader", F.least("h", F.coalesce("has", F.lit(0))).alias("n_head"))


def numbered(turns: DataFrame, blocks: DataFrame, kin: DataFrame) -> DataFrame:
    """``conv, pos, at, ha, hb``: the place of each turn in its conversation from 0, and in the rebuilt one (null for turns that are dropped).

    The order is by turn (null first, in the order of the hash), role and hash.
    """
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    skip = blocks.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).join(kin, "conv").select("conv", "block", "skip", "h", "n_head")
    order = Window.partitionBy("conv", "block").orderBy(F.when(F.col("turn").isNull(), F.col("hb")), "turn", "role", "hb", "ha")
    rows = turns.withColumn("nth", F.row_number().over(order)).join(skip, ["conv", "block"]).withColumn("pos", F.col("nth") - 1 + F.col("skip"))
    return rows.select("conv", "pos", F.when(F.col("pos") >= F.col("h"), F.col("pos") - F.col("h") + F.col("n_head")).alias("at"), "ha", "hb")


def rebuilt(rows: DataFrame, kin: DataFrame) -> DataFrame:
    """``conv, pos, id, tokens`` of the rebuilt conversations. A leader's first turns, fewer than ``SHARED``, go to at most the ids of its group."""
    own = rows.filter("at is not null").select("conv", F.col("at").alias("pos"), "id", "tokens")
    first = rows.filter((F.col("conv") % GROUP == 0) & (F.col("pos") < SHARED - 1)).groupBy(F.col("conv").alias("leader")).agg(F.collect_list(F.struct("pos", "id", "tokens")).alias("first"))
    heads = kin.filter("n_head > 0").join(first, "leader").select("conv", "h", F.inline("first")).filter("pos < h")
    return own.unionByName(heads.select("conv", "pos", "id", "tokens"))


def id_hashes(members: DataFrame, most: int = TEXT) -> DataFrame:
    """``len, x1, x2, sha`` of the groups of ``members(len, x1, x2, conv)``: SHA-256 of the ids of each, ascending, with commas.

    Members are sorted over all tasks. A task hashes the groups that lie wholly within it; of those at its
    ends, and of very large ones, it joins the ids to texts of about ``most`` characters, which then stream
    through one hash a group in order.
    """
    keys = ["len", "x1", "x2"]
    names = [*keys, "first", "ids", "sha"]
    schema = "len bigint, x1 bigint, x2 bigint, first bigint, ids string, sha string"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of(None)
        key, ids, at_edge, out = None, [], True, []  # what of the present group is not yet told; whether others may have parts of it
        for batch in batches:
            a, b, c, conv = (batch.column(i).to_numpy() for i in range(4))
            edges = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]), True])
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                now = (int(a[start]), int(b[start]), int(c[start]))
                if now != key:
                    if ids:
                        text = ",".join(map(str, ids))
                        out.append((*key, ids[0], text, None) if at_edge else (*key, 0, None, hashlib.sha256(text.encode()).hexdigest()))
                    key, ids, at_edge = now, [], key is None
                ids += conv[start:end].tolist()
                if len(ids) * 8 > most:
                    out.append((*key, ids[0], ",".join(map(str, ids)), None))
                    ids, at_edge = [], True
            if out:
                yield batch_of(out)
                out = []
        if ids:
            yield batch_of([(*key, ids[0], ",".join(map(str, ids)), None)])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            for a, b, c, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if (a, b, c) != key:
                    if key is not None:
                        yield batch_of([(*key, 0, None, sha.hexdigest())])
                    key, sha = (a, b, c), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
        if key is not None:
            yield batch_of([(*key, 0, None, sha.hexdigest())])

    dealt = members.select(*keys, "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv")
    found = written(dealt.mapInArrow(texts, schema), "trie-ids")
    rest = found.filter("sha is null").repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(streamed, schema)
    return found.filter("sha is not null").unionByName(rest).select(*keys, "sha")


class Nodes:
    """Nodes of many buckets that a task finishes: multikey quicksort of their sequences by the turns after the bucket's own."""

    def __init__(self, table: pa.Table):
        get = lambda c: table[c].combine_chunks()
        self.ends = get("end")
        self.seq, self.id, self.tokens, self.weight = (get(c).to_numpy() for c in ("seq", "id", "tokens", "weight"))
        bucket, level = get("bucket").to_numpy(), get("depth").to_numpy()
        new_cell = np.r_[True, (bucket[1:] != bucket[:-1]) | (level[1:] != level[:-1])]
        starts = np.flatnonzero(new_cell | np.r_[True, self.seq[1:] != self.seq[:-1]])
        self.start, self.size = starts, np.diff(np.r_[starts, len(bucket)])
        cells = np.flatnonzero(new_cell[starts])
        n = len(bucket)  # each row adds one node at most
        self.conv, self.depth, self.parent, self.n_convs, self.saved, self.end_row, self.top_row = (np.zeros(n, np.int64) for _ in range(7))
        self.made = 0
        self.top_row[:] = -1
        for a, b in zip(cells, np.r_[cells[1:], len(starts)]):
            top = self.add(np.arange(a, b), 0, int(level[starts[a]]), -1)
            self.top_row[top] = starts[a]
            self.sort(np.arange(a, b), int(level[starts[a]]), top)

    def add(self, own: np.ndarray, k: int, depth: int, parent: int) -> int:
        """The node of the sequences ``own`` after ``k`` turns beyond the bucket's own; they are in the order of their names."""
        i, self.made = self.made, self.made + 1
        rows = self.start[own] + k
        done = rows[self.size[own] == k + 1]
        self.conv[i], self.depth[i], self.parent[i], self.n_convs[i] = self.seq[rows[0]], depth, parent, self.weight[rows].sum()
        self.saved[i] = (self.n_convs[i] - 1) * self.tokens[rows[0]]
        self.end_row[i] = done[0] if len(done) else -1  # sequences differ, so one ends here at most
        return i

    def sort(self, own: np.ndarray, depth: int, top: int) -> None:
        todo = [(own, 1, top)]
        while todo:
            own, k, node = todo.pop()
            own = own[self.size[own] > k]
            if not len(own):
                continue
            if len(own) == 1:
                self.chain(int(own[0]), k, depth + k, node)
                continue
            turns = self.id[self.start[own] + k]
            pivot = turns[len(turns) // 2]
            for part in (turns < pivot, turns > pivot):
                if part.any():
                    todo.append((own[part], k, node))
            equal = own[turns == pivot]
            todo.append((equal, k + 1, self.add(equal, k, depth + k, node)))

    def chain(self, s: int, k: int, depth: int, node: int) -> None:
        """The nodes of one sequence from ``k`` turns on."""
        first, n, i = self.start[s] + k, int(self.size[s]) - k, self.made
        own = slice(i, i + n)
        self.conv[own], self.depth[own], self.n_convs[own] = self.seq[first], np.arange(depth, depth + n), self.weight[first]
        self.parent[own] = np.r_[node, np.arange(i, i + n - 1)]
        self.saved[own] = (self.weight[first] - 1) * self.tokens[first : first + n]
        self.end_row[own] = -1
        self.end_row[i + n - 1] = first + n - 1
        self.made += n

    def batch(self, table: pa.Table) -> pa.RecordBatch:
        n = self.made
        parent, children = self.parent[:n], np.zeros(n, np.int64)
        inner = parent >= 0
        np.add.at(children, parent[inner], 1)
        saved, leaves = self.saved[:n].tolist(), (children == 0).astype(np.int64).tolist()
        for i, p in zip(range(n - 1, -1, -1), parent[::-1].tolist()):  # children come after their parents
            if p >= 0:
                saved[p] += saved[i]
                leaves[p] += leaves[i]
        at = lambda rows: pa.array(np.where(rows >= 0, rows, 0), mask=rows < 0)
        tops = at(self.top_row[:n])
        of_top = {c: table[c].combine_chunks().take(tops) for c in ("parent", "up", "up_depth")}
        parents = pa.array(np.where(inner, self.conv[np.where(inner, parent, 0)], 0), mask=~inner)
        columns = {
            "conv_id": pa.array(self.conv[:n]), "depth": pa.array(self.depth[:n]), "parent": pc.coalesce(parents, of_top["parent"]),
            "n_convs": pa.array(self.n_convs[:n]), "n_children": pa.array(children), "n_leaves": pa.array(leaves, pa.int64()), "saved": pa.array(saved, pa.int64()),
            "end": self.ends.take(at(self.end_row[:n])), "up": of_top["up"], "up_depth": of_top["up_depth"],
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


NODE = "conv_id bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, end string, up bigint, up_depth bigint"


def finished(rows: DataFrame) -> DataFrame:
    """The nodes of small buckets, all rows of a bucket in one task; ``up, up_depth`` name the bucket above at a bucket's own node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of(None)
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            bucket, level = held["bucket"].to_numpy(), held["depth"].to_numpy()
            other = np.flatnonzero((bucket != bucket[-1]) | (level != level[-1]))
            if len(other):
                whole = held.slice(0, int(other[-1]) + 1)
                yield Nodes(whole).batch(whole)
                held = held.slice(int(other[-1]) + 1)
        if held is not None and held.num_rows:
            yield Nodes(held).batch(held)

    return rows.repartition("bucket", "depth").sortWithinPartitions("bucket", "depth", "seq", "pos").mapInArrow(run, NODE)


class Round:
    """One round over the large buckets ``tops(bucket, depth, parent, n_convs, tokens, end, up, up_depth)`` with their ``rows``."""

    def __init__(self, tops: DataFrame, rows: DataFrame, local: int):
        self.tops, many = tops, hot_from(rows.count())
        self.levels = written(
            rows.filter("pos >= depth").groupBy("bucket", "depth", "pos").agg(
                F.min("id").alias("low"), F.max("id").alias("high"), F.sum("weight").alias("n_convs"), F.min("seq").alias("conv"), F.max("tokens").alias("tokens"), F.max("end").alias("end"), F.count("*").alias("n")
            ), "trie-levels"
        )
        fork = self.levels.groupBy("bucket", "depth").agg(F.min(F.when(F.col("low") != F.col("high"), F.col("pos"))).alias("fork"), F.max("pos").alias("last"), F.sum("n").alias("n"))
        fork = fork.select("bucket", "depth", "n", "fork", F.coalesce("fork", F.col("last") + 1).alias("to"))
        tail = self.levels.select("bucket", (F.col("pos") + 1).alias("to"), F.col("conv").alias("tail"))
        self.forks = written(fork.join(tail, ["bucket", "to"], "left").withColumn("tail", F.coalesce("tail", "bucket")), "trie-forks")
        heads = meet(rows, self.forks.filter("fork is not null").select("bucket", "n", "to", "tail"), "bucket", many).filter("pos = to")
        heads = written(heads, "trie-heads")
        kids = heads.groupBy("bucket", "id").agg(
            F.min("seq").alias("kid"), F.sum("weight").alias("n_convs"), F.max("tokens").alias("tokens"), F.max("end").alias("end"), F.max(F.col("to") + 1).alias("kid_depth"),
            F.max("tail").alias("parent"), F.max("depth").alias("up_depth"), (F.sum(F.col("len") - F.col("to")) > local).alias("large"), F.count("*").alias("n"),
        )
        self.kids = written(kids, "trie-kids")
        dealt = meet(heads.select("bucket", "id", "seq", (F.col("len") - F.col("to")).alias("left")), self.kids.select("bucket", "id", "kid", "kid_depth", "parent", "up_depth", "large", "n"), ["bucket", "id"], many)
        dealt = written(dealt.select("seq", "kid", "kid_depth", F.col("parent").alias("above"), F.col("bucket").alias("over"), F.col("up_depth").alias("over_depth"), "large", F.col("left").alias("n")), "trie-dealt")
        own = ["seq", "pos", "id", "tokens", "weight", "len", "end"]
        after = meet(rows.select(*own), dealt, "seq", many).filter("pos >= kid_depth - 1")
        names = [F.col("kid").alias("bucket"), F.col("kid_depth").alias("depth"), F.col("above").alias("parent"), F.col("over").alias("up"), F.col("over_depth").alias("up_depth")]
        self.after = written(after.select(*own, *names, "large"), "trie-rows")
        discard(heads, dealt)

    def next_tops(self) -> DataFrame:
        return self.kids.filter("large").select(F.col("kid").alias("bucket"), F.col("kid_depth").alias("depth"), "parent", "n_convs", "tokens", "end", F.col("bucket").alias("up"), "up_depth")

    def nodes(self, below: DataFrame) -> DataFrame:
        """The nodes of this round's buckets, from the sums ``below(up, up_depth, leaves, saved)`` of the buckets under them."""
        forks = self.forks.select("bucket", F.col("depth").alias("of"), "to")
        chain = self.levels.withColumnRenamed("depth", "of").join(forks, ["bucket", "of"]).filter("pos < to").withColumn("depth", F.col("pos") + 1)
        above = self.levels.select("bucket", F.col("depth").alias("of"), (F.col("pos") + 1).alias("pos"), F.col("conv").alias("above"))
        chain = chain.join(above, ["bucket", "of", "pos"], "left").withColumn("parent", F.coalesce("above", "bucket"))
        none = F.lit(None).cast("bigint")
        chain = chain.select("bucket", "of", "depth", "to", "conv", "parent", "n_convs", "tokens", "end", none.alias("up"), none.alias("up_depth"))
        tops = self.tops.join(self.forks.select("bucket", "depth", "to"), ["bucket", "depth"], "left")
        tops = tops.select("bucket", F.col("depth").alias("of"), "depth", F.coalesce("to", "depth").alias("to"), F.col("bucket").alias("conv"), "parent", "n_convs", "tokens", "end", "up", "up_depth")
        kids = self.kids.groupBy("bucket", F.col("up_depth").alias("of")).agg(F.count("*").alias("n_kids"))
        sums = below.select(F.col("up").alias("bucket"), F.col("up_depth").alias("of"), "leaves", F.col("saved").alias("under"))
        rows = chain.unionByName(tops).withColumn("block", F.floor(F.col("depth") / F.lit(TURNS))).withColumn("own", (F.col("n_convs") - 1) * F.col("tokens"))
        later = Window.partitionBy("bucket", "of").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        blocks = rows.groupBy("bucket", "of", "block").agg(F.sum("own").alias("s"))
        blocks = blocks.select("bucket", "of", "block", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("later"))
        blocks = blocks.join(kids, ["bucket", "of"], "left").join(sums, ["bucket", "of"], "left")
        within = Window.partitionBy("bucket", "of", "block").orderBy(F.desc("depth"))
        rows = rows.withColumn("upto", F.sum("own").over(within)).join(blocks, ["bucket", "of", "block"])
        return rows.select(
            F.col("conv").alias("conv_id"), "depth", "parent", "n_convs", F.when(F.col("depth") < F.col("to"), 1).otherwise(F.coalesce("n_kids", F.lit(0))).cast("bigint").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"), (F.col("upto") + F.col("later") + F.coalesce("under", F.lit(0))).alias("saved"), "end", "up", "up_depth",
        )


def sums_of(nodes: DataFrame) -> DataFrame:
    """``up, up_depth, leaves, saved``: what the buckets below each bucket add to it."""
    return nodes.filter("up is not null").groupBy("up", "up_depth").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``seqs(seq, len, weight, sha)``, one for all conversations that are equal when rebuilt, under the smallest id; and ``rows(seq, pos, id, tokens, weight, len, end)``."""
    marks = written(hashed(turns), "trie-turns")
    blocks = written(marks.groupBy("conv", "block").agg(F.count("*").alias("n")), "trie-blocks")
    kin = written(families(blocks), "trie-kin")
    many = hot_from(marks.count())
    words = marks.groupBy("ha", "hb").agg(F.count("*").alias("n"), F.max("tokens").alias("tokens"))
    words = written(words.withColumn("id", F.monotonically_increasing_id()), "trie-words")  # the dictionary of turns
    places = written(numbered(marks, blocks, kin), "trie-places")
    rows = written(meet(places, words, ["ha", "hb"], many).select("conv", "pos", "at", "id", "tokens"), "trie-coded")
    discard(marks, blocks, words, places)
    whole = rebuilt(rows, kin)
    x = lambda k, *c: F.bit_xor(F.xxhash64(F.lit(k), *c))
    members = whole.groupBy("conv").agg(F.count("*").alias("len"), x(1, "pos", "id").alias("x1"), x(2, "id", "pos").alias("x2"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    members = written(kin.select("conv").join(members, "conv", "left").select("conv", zero("len"), zero("x1"), zero("x2")), "trie-members")
    groups = members.groupBy("len", "x1", "x2").agg(F.min("conv").alias("seq"), F.count("*").alias("weight"))
    seqs = written(groups.join(id_hashes(members), ["len", "x1", "x2"]).select("seq", "len", "weight", "sha"), "trie-seqs")
    table = seqs.filter("len > 0").select(F.col("seq").alias("conv"), F.col("len").alias("n"), F.col("len").alias("size"), "weight", "sha")
    own = meet(whole, table, "conv", many)
    end = F.when(F.col("pos") == F.col("size") - 1, F.col("sha")).alias("end")
    out = written(own.select(F.col("conv").alias("seq"), "pos", "id", "tokens", "weight", F.col("size").alias("len"), end), "trie-rows")
    discard(rows, kin, members)
    return seqs, out


def prefix_trie(turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie of rebuilt conversations of ``turns(conv_id, turn, role, text)``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A conversation is ordered by turn (null first, in the order of a hash; ties by role, then by a hash); null roles
    and texts are empty; every repeated row is a turn of its own. Its first ``h = crc32(id) % 4`` turns are put in by
    the first ``h`` of conversation ``id - id % 20`` (all if it has fewer, none if it is absent). Rows without a
    ``conv_id`` are of no conversation. Further columns are ignored; texts are taken whole; an empty table gives
    an empty result.

    A bucket of more than ``local`` turns is dealt by one more turn, so the rounds are as many as the forks on a path on
    which buckets stay larger than that; a bucket is never in one task before. The ids of one group of equal
    conversations pass one task in order, as their hash asks for, in a stream of texts.
    """
    seqs, rows = sequences(turns)
    root = seqs.agg(F.min("seq").alias("conv"), F.sum("weight").alias("n"), F.max(F.when(F.col("len") == 0, F.col("sha"))).alias("end")).first()
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    key = F.lit(root["conv"]).cast("bigint").alias("bucket")
    tops = seqs.sparkSession.range(0 if root["conv"] is None else 1).select(
        key, zero.alias("depth"), none.alias("parent"), F.lit(root["n"]).cast("bigint").alias("n_convs"), zero.alias("tokens"), F.lit(root["end"]).cast("string").alias("end"), none.alias("up"), none.alias("up_depth")
    )
    rows = rows.select("*", key, zero.alias("depth"), none.alias("parent"), none.alias("up"), none.alias("up_depth"))
    rounds, small = [], []
    while True:
        done = Round(tops, rows, local)
        rounds.append(done)
        small.append(done.after.filter("not large").drop("large"))
        rows, tops = done.after.filter("large").drop("large"), done.next_tops()
        if rows.limit(1).count() == 0:
            break
    nodes = [written(finished(reduce(DataFrame.unionByName, small)), "trie-nodes")]
    low = sums_of(nodes[0])
    for done in reversed(rounds):
        nodes.append(written(done.nodes(low if len(nodes) == 1 else sums_of(reduce(DataFrame.unionByName, nodes))), "trie-nodes"))
        discard(done.levels, done.forks, done.after)
    out = reduce(DataFrame.unionByName, nodes)
    return out.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("end", F.lit(NOTHING)).alias("ends_sha256")
    )


#: The same in DuckDB: CRC-32 bit by bit, nodes as lists of turns.
ORACLE_SQL = f"""
WITH bits AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b] || range(0, 8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS tab),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x
      FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY pos) AS xs FROM t GROUP BY c),
h AS (SELECT c, xs, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT)), lambda a, d: xor(a >> 8, tab[CAST(xor(a, d) & 255 AS BIGINT) + 1])), 4294967295) % {SHARED} AS h
      FROM own, bits),
r AS (SELECT h.c, coalesce(list_slice(l.xs, 1, h.h), []) || list_slice(h.xs, h.h + 1, len(h.xs)) AS xs FROM h LEFT JOIN own l ON l.c = h.c - h.c % {GROUP}),
m AS (SELECT c, d, list_slice(xs, 1, d) AS path, d = len(xs) AS whole FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN whole THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM m GROUP BY path, d),
k AS (SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.path[n.d]['t'], '{WORD}')) END AS own
      FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.path = list_slice(n.path, 1, n.d - 1)),
kids AS (SELECT parent_conv_id, d - 1 AS d, count(*) AS n FROM k WHERE d > 0 GROUP BY ALL),
f AS (SELECT k.*, coalesce(kids.n, 0) AS n_children FROM k LEFT JOIN kids ON kids.parent_conv_id = k.conv_id AND kids.d = k.d),
up AS (SELECT a.conv_id, a.d, f.own, f.n_children FROM f JOIN m ON m.c = f.conv_id AND m.d <= f.d JOIN f a ON a.d = m.d AND a.path = m.path),
s AS (SELECT conv_id, d, CAST(sum(own) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY conv_id, d)
SELECT f.conv_id, f.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN s ON f.conv_id = s.conv_id AND f.d = s.d
"""
