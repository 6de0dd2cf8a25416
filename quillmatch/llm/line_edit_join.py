"""Line dedup by a segment-partition edit join.

A line with a word goes if an earlier line of the corpus equals it or lies within ``edits`` edits of
it; with ``per_edit`` the shorter of two lines has to have so many characters for each edit (0: all lines may
have all edits). For the near ones each distinct line is split into one segment more than its edits; two
lines within the threshold share one of them whole, at a place that their lengths and the number of edits
bound. Where fewer edits are allowed, lines have segments of their own. Lines of no more characters than edits have too few
for the segments; these and the lines that they can reach meet at what deletions leave of them. So segments are indexed by (length, number, hash) and every line probes the substrings
that can match an index entry of a line as long or shorter (length-aware, multi-match-aware
selection); an index entry stands for the probe of the same key too. Candidates are verified where they meet, by a banded bit-parallel edit distance, so only
lines that have to go leave a task, never pairs; keys that many lines share are dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.grouping import block_pairs, in_cells
from quillmatch.llm.shared import as_row, discard, in_tasks, row_key, same_key, with_texts, written

EDITS = 2
LEAST = 1  #: Characters below which a line is left alone; lines without a word always are.
PER_EDIT = 15  #: Default of the characters that a line needs for each edit, as near copies are those that differ in a small share; 0: none.
SIGN_BITS = 24  #: Bits of a line's id that hold the parity of its characters' counts, by character bucket.
SLICE = 300_000  #: Characters that are hashed, or of candidates that are compared, at once.
BLOCK = 1024  #: Entries of one key that one task compares with as many others.
FILTER_BITS = 1 << 27  #: Of the map of keys that meet; it has 16 MB at any size, and lets through more where it is fuller.
SEEN = 200_000  #: Lines that a task remembers having indexed.
SPACE = " \t\n\x0b\x0c\r"  #: What stands between words.

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"], _POWERS["down"]


def selection(edits: int) -> list[tuple[int, int, int]]:
    """``(shorter, segment, shift)``: where a line probes the segment of a line ``shorter`` characters shorter.

    Without the probes at a line's own segments (0, segment, 0): these have the keys of its index entries,
    so lines of equal length that share a segment at its place meet as index entries.
    """
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            lo = max(-i, shorter - (edits - i))
            hi = min(i, shorter + (edits - i))
            out += [(shorter, i, shift) for shift in range(lo, hi + 1) if shorter or shift]
    return out


def edits_of(size: int, edits: int, per_edit: int) -> int:
    """The edits between two lines of which the shorter has ``size`` characters."""
    return min(edits, size // per_edit) if per_edit else edits


def of_edits(lines: list[str], allowed: int, edits: int, per_edit: int) -> np.ndarray:
    """Which lines meet others within ``allowed`` edits: where the shorter of two allows so many, and the longer ones it may meet."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    if not per_edit:
        return np.arange(len(lines) if allowed == edits else 0)
    most = (allowed + 1) * per_edit - 1 + allowed
    return np.flatnonzero((size >= allowed * per_edit) & ((size <= most) | (allowed == edits)))


def line_ids(line: str) -> tuple[int, int]:
    """128 bits of hash as two signed longs."""
    h = xxhash.xxh3_128_intdigest(line.encode())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and starts of lines, and a hash of each of their characters."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return size, np.cumsum(size) - size, _mix(chars + np.uint64(0x1234567))


def _parity(mixed: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduceat(np.uint64(1) << (mixed % np.uint64(SIGN_BITS)), start)


def named(ids: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """40 bits of the hashes of lines, and their parity signs."""
    return ((ids.view(np.uint64) >> np.uint64(SIGN_BITS)) << np.uint64(SIGN_BITS)) | sign


def in_parts(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of a list of lines of about ``SLICE`` characters (a longer line is one alone)."""
    start = held = 0
    for i, line in enumerate(lines):
        held += len(line)
        if held >= SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lines):
        yield start, len(lines)


def signatures(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: a parity sign, its index keys and its probe keys (0: none, as a line is too short)."""
    size, start, mixed = _characters(lines)
    up, down = _powers(len(mixed) + 1)
    rolled = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed * up[: len(mixed)], out=rolled[1:])
    sign = _parity(mixed, start)

    def keys(at: np.ndarray, length: np.ndarray, segment: int, of: np.ndarray) -> np.ndarray:
        part = (rolled[at + length] - rolled[at]) * down[at]
        return _mix(_mix(part) + of.astype(np.uint64) * np.uint64(64) + np.uint64(segment)) | np.uint64(1)

    def cut(of: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of a segment of a line of length ``of``: the last ones are longer by one."""
        n = edits + 1
        base, longer = of // n, of % n
        place = segment * base + np.maximum(segment - (n - longer), 0)
        return place, base + (segment >= n - longer)

    index, probe = [], []
    enough = size >= edits + 1
    for i in range(edits + 1):
        place, length = cut(size, i)
        index.append(np.where(enough, keys(start + place, length, i, size), np.uint64(0)))
    for shorter, i, shift in selection(edits):
        of = np.maximum(size - shorter, edits + 1)
        place, length = cut(of, i)
        place = place + shift
        fits = (place >= 0) & (place + length <= size) & (size - shorter >= edits + 1)
        place = np.where(fits, place, 0)
        probe.append(np.where(fits, keys(start + place, np.where(fits, length, 1), i, of), np.uint64(0)))
    return sign, np.stack(index, axis=1), np.stack(probe, axis=1)


def deletions(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of what up to ``edits`` deletions leave of each line of at most twice so many characters.

    Two lines within ``edits`` edits have one of these in common. If one is too short for segments, both are as short as this.
    """
    row, key = [], []
    for i, line in enumerate(lines):
        if len(line) <= 2 * edits:
            for left in {"".join(x) for n in range(max(0, len(line) - edits), len(line) + 1) for x in combinations(line, n)}:
                row.append(i)
                key.append(xxhash.xxh64_intdigest(left.encode(), seed=edits) | 1)
    return np.array(row, np.int64), np.array(key, np.uint64)


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Which pairs lie within ``edits`` edits: all pairs advance together, one column of the band each step.

    The band of width ``2 * edits + 1`` around the diagonal is held as vertical differences in the top
    bits of a word for each pair.
    """
    out = np.zeros(len(a), bool)
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    near = np.flatnonzero((np.abs(la - lb) <= edits) & (la > edits) & (lb > edits))
    near = near[np.argsort(la[near], kind="stable")]  # lines of a length together
    at = 0
    while at < len(near):
        # As many pairs as the longest of the next few thousand leaves room for; a very long pair is alone.
        some = near[at : at + 2048]
        some = some[: max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * la[some], SLICE, side="right")))]
        at += len(some)
        # The pattern is the longer of each pair.
        pat = [a[i] if la[i] >= lb[i] else b[i] for i in some]
        txt = [b[i] if la[i] >= lb[i] else a[i] for i in some]
        order = np.argsort([len(t) for t in txt], kind="stable")[::-1]
        some, pat, txt = some[order], [pat[i] for i in order], [txt[i] for i in order]
        m, n = np.array([len(x) for x in pat]), np.array([len(x) for x in txt])
        width = int(m.max()) + 2 * edits + 2
        p = np.zeros((len(some), width), np.uint32)
        t = np.zeros((len(some), int(n.max())), np.uint32)
        for k, (x, y) in enumerate(zip(pat, txt)):
            p[k, edits : edits + len(x)] = np.frombuffer(x.encode("utf-32-le"), np.uint32) + 1
            t[k, : len(y)] = np.frombuffer(y.encode("utf-32-le"), np.uint32) + 1
        p, t = np.ascontiguousarray(p.T), np.ascontiguousarray(t.T)
        one = np.uint64(1)
        vp = np.full(len(some), ((1 << 64) - 1) ^ ((1 << (63 - edits)) - 1), np.uint64)
        vn = np.zeros(len(some), np.uint64)
        dist = np.full(len(some), edits, np.int64)
        for j in range(int(n.max())):
            live = int(np.searchsorted(-n, -j, side="left"))  # texts longer than j come first
            x = np.zeros(live, np.uint64)
            for k in range(2 * edits + 1):
                x |= (p[j + k, :live] == t[j, :live]).astype(np.uint64) << np.uint64(63 - 2 * edits + k)
            v, w = vp[:live], vn[:live]
            d0 = (((x & v) + v) ^ v) | x | w
            hp = w | ~(d0 | v)
            hn = d0 & v
            diagonal = j < m[:live] - edits
            bit = np.where(diagonal, 0, 62 - (j - (m[:live] - edits))).astype(np.uint64)
            step = np.where(diagonal, 1 - (d0 >> np.uint64(63)).astype(np.int64), ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
            dist[:live] += step
            shifted = d0 >> one
            vp[:live] = hn | ~(shifted | hp)
            vn[:live] = shifted & hp
        out[some] = dist <= edits
    short = np.flatnonzero((np.abs(la - lb) <= edits) & ~((la > edits) & (lb > edits)))
    out[short] = [_distance(a[i], b[i]) <= edits for i in short]
    return out


def _distance(a: str, b: str) -> int:
    """Edit distance of two texts of a few characters, too short for a band."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """``rk_*, line_no, h_a, h_b`` for the lines of at least ``least`` characters that have a word."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, no, first, second = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for n, line in enumerate(text.split("\n") if text else ()):
                    if len(line) >= least and line.strip(SPACE):
                        x, y = line_ids(line)
                        who.append(i)
                        no.append(n)
                        first.append(x)
                        second.append(y)
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(take) for k in range(3)), pa.array(no, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64())],
                names=["rk_id", "rk_a", "rk_b", "line_no", "h_a", "h_b"],
            )

    return in_tasks(docs.select(*row_key(), "text"), run, f"rk_id {kind}, rk_a bigint, rk_b bigint, line_no int, h_a bigint, h_b bigint", text=3)


def key_map(keys: DataFrame) -> np.ndarray:
    """A bit for each of ``FILTER_BITS`` hash values of ``keys(key)``, as words of 64."""
    marks = keys.select(F.expr(f"pmod(shiftright(key, 8), {FILTER_BITS})").alias("bit"))
    words = marks.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mark"))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:  # 8,192 words at most
        out = np.zeros(1 << 13, np.int64)
        out[frame["word"].to_numpy() % (1 << 13)] = frame["mark"].to_numpy()
        return pd.DataFrame({"part": frame["part"].iloc[:1], "bits": [out.tobytes()]})

    parts = words.withColumn("part", F.shiftright("word", 13)).groupBy("part").applyInPandas(packed, "part bigint, bits binary")
    out = np.zeros((FILTER_BITS >> 19, 1 << 13), np.uint64)
    for row in parts.collect():  # 256 rows of 64 kB
        out[row["part"]] = np.frombuffer(row["bits"], np.uint64)
    return out.ravel()


def entries(docs: DataFrame, least: int, edits: int, per_edit: int, wanted: np.ndarray | None = None) -> DataFrame:
    """``key, line, probe`` of every line that may have an edit: its index entries (``probe`` 0) and probes (1).

    ``line`` is 40 bits of the line's hash and its parity sign. A task leaves out lines that it has
    just seen; what other tasks repeat goes when equal keys meet. With ``wanted``, a map of keys, entries
    of keys that are not in it stay behind.
    """

    def keyed(lines: list[str], ids: np.ndarray, allowed: int) -> pa.RecordBatch:
        sign, index, probe = signatures(lines, allowed)
        line = named(ids, sign)
        key = np.concatenate([index, probe], axis=1)
        who = np.repeat(line, key.shape[1])
        what = np.tile(np.r_[np.zeros(index.shape[1]), np.ones(probe.shape[1])].astype(bool), len(line))
        row, left = deletions(lines, allowed)
        key, who, what = np.r_[key.ravel(), left], np.r_[who, line[row]], np.r_[what, np.zeros(len(row), bool)]
        some = key != 0
        if wanted is not None:
            bit = (key >> np.uint64(8)) & np.uint64(FILTER_BITS - 1)
            some &= (wanted[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(who[some].view(np.int64)), pa.array(what[some])], names=["key", "line", "probe"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held: list[str] = []
            ids: list[int] = []
            chars = 0
            for n in range(batch.num_rows + 1):
                text = batch.column(0)[n].as_py() if n < batch.num_rows else None
                for line in text.split("\n") if text else ():
                    if len(line) >= max(least, per_edit) and line.strip(SPACE):
                        h = line_ids(line)[0]
                        if h not in seen:
                            if len(seen) > SEEN:
                                seen.clear()
                            seen.add(h)
                            held.append(line)
                            ids.append(h)
                            chars += len(line)
                if held and (chars > SLICE or n == batch.num_rows):
                    for allowed in range(1, edits + 1):
                        own = of_edits(held, allowed, edits, per_edit)
                        if len(own):
                            yield keyed([held[i] for i in own], np.array(ids, np.int64)[own], allowed)
                    held, ids, chars = [], [], 0

    return in_tasks(docs.select("text").filter("text is not null"), run, "key bigint, line bigint, probe boolean", text=0)


def members(docs: DataFrame, least: int, edits: int, per_edit: int) -> DataFrame:
    """``key, line, probe``: the entries of keys at which an index entry meets another line's entry."""
    found = entries(docs, least, edits, per_edit)
    flags = found.groupBy("key").agg(F.min("line").alias("least"), F.max("line").alias("most"), F.min("probe").alias("all_probes"))
    meet = written(flags.filter("least <> most and not all_probes").select("key"), "lines-keys")
    return entries(docs, least, edits, per_edit, key_map(meet)).join(meet, "key", "left_semi").distinct()


def bodies(docs: DataFrame, wanted: np.ndarray, least: int, per_edit: int) -> DataFrame:
    """``line, h_a, h_b, body`` of the lines whose names are in a map; a task leaves out those that it has just seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            held: list[str] = []
            ids: list[tuple[int, int]] = []
            for text in batch.column(0).to_pylist():
                for line in text.split("\n"):
                    if len(line) >= max(least, per_edit) and line.strip(SPACE):
                        h = line_ids(line)
                        bit = (h[0] >> SIGN_BITS) & (FILTER_BITS - 1)
                        if int(wanted[bit >> 6]) >> (bit & 63) & 1 and h not in seen:
                            if len(seen) > SEEN:
                                seen.clear()
                            seen.add(h)
                            held.append(line)
                            ids.append(h)
            for at, end in in_parts(held):
                a, b = (np.array(x, np.int64) for x in zip(*ids[at:end]))
                _, start, mixed = _characters(held[at:end])
                name = named(a, _parity(mixed, start)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(a), pa.array(b), pa.array(held[at:end], pa.string())], names=["line", "h_a", "h_b", "body"])

    return in_tasks(docs.select("text").filter("text is not null"), run, "line bigint, h_a bigint, h_b bigint, body string", text=0)


def near_lines(docs: DataFrame, first: DataFrame, least: int, edits: int, per_edit: int) -> DataFrame:
    """``h_a, h_b`` of the distinct lines that an earlier distinct line lies within ``edits`` of, or what their lengths allow.

    ``first(h_a, h_b, at)`` has every distinct line's first place.
    """
    met = written(members(docs, least, edits, per_edit), "lines-members")
    short = F.shiftright("h_a", SIGN_BITS)
    names = met.select(F.shiftright("line", SIGN_BITS).alias("short")).distinct()
    places = first.withColumn("short", short).join(names, "short", "left_semi").select("h_a", "h_b", "at")
    texts = bodies(docs, key_map(names.select(F.shiftleft("short", 8).alias("key"))), least, per_edit).dropDuplicates(["h_a", "h_b"])
    texts = written(texts.join(places, ["h_a", "h_b"]).select("line", "h_a", "h_b", "at", "body"), "lines-texts")
    cells = block_pairs(met, "key", "line", BLOCK).drop("key").join(texts, "line")
    verifier = Verifier(edits, per_edit)
    near = written(in_cells(cells, verifier, "h_a bigint, h_b bigint", verifier.finish).distinct(), "lines-near")
    discard(met, texts)
    return near


class Verifier:
    """Finds the candidates of each cell and verifies those of many cells together; gives the hashes of the later lines.

    The candidates of a cell are taken from its earliest lines on, a bounded part at a time; a line that has
    been found near an earlier one is the later line of no further candidate there.
    """

    def __init__(self, edits: int, per_edit: int = PER_EDIT):
        self.edits, self.per_edit, self.chars = edits, per_edit, 0
        self.pairs: list[tuple[str, str, tuple[int, int]]] = []
        self.later: set[tuple[int, int]] = set()

    def __call__(self, table: pa.Table, start: int, end: int) -> pa.RecordBatch | None:
        own = table.slice(start, end - start)
        line, probe, side = own["line"].to_numpy().view(np.uint64), own["probe"].to_numpy(), own["side"].to_numpy()
        two = bool(side.any())
        _, row, name = np.unique(own["h_a"].to_numpy(), return_index=True, return_inverse=True)
        met = [np.zeros(0, np.int64)]
        for of in (0, 1) if two else (0,):
            i = np.flatnonzero(~probe & (side == of)) if two else np.flatnonzero(~probe)
            j = np.flatnonzero(side != of) if two else np.arange(len(line))
            # One edit changes the parity of two characters at most.
            apart = np.bitwise_count((line[i][:, None] ^ line[j][None, :]) & np.uint64((1 << SIGN_BITS) - 1))
            x, y = np.nonzero((apart <= 2 * self.edits) & (name[i][:, None] != name[j][None, :]))
            a, b = name[i[x]], name[j[y]]
            met.append(np.unique(np.minimum(a, b) * len(row) + np.maximum(a, b)))
        a, b = np.divmod(np.unique(np.concatenate(met)), len(row))
        if len(a):
            self._hold(own, row, a, b)
        return self._given()

    def _hold(self, own: pa.Table, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Keeps the candidates ``a[k], b[k]`` (of which ``row`` gives the rows) to verify, or does so when they are many."""
        some = np.unique(np.r_[a, b])
        place = {k: tuple(own["at"][int(row[k])].as_py().values()) for k in some.tolist()}
        rank = np.zeros(len(row), np.int64)
        rank[sorted(place, key=place.__getitem__)] = np.arange(len(some))
        first, last = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
        order = np.lexsort((rank[last], rank[first]))
        read: dict[int, tuple[str, tuple[int, int]]] = {}
        for pair in zip(first[order].tolist(), last[order].tolist()):
            for k in pair:
                if k not in read:
                    at = int(row[k])
                    read[k] = own["body"][at].as_py(), (own["h_a"][at].as_py(), own["h_b"][at].as_py())
            (early, _), (late, h) = read[pair[0]], read[pair[1]]
            if h not in self.later:
                self.pairs.append((early, late, h))
                self.chars += len(late)
                if self.chars > 4 * SLICE:
                    self._verify()

    def _verify(self) -> None:
        for allowed in range(1, self.edits + 1):
            own = [p for p in self.pairs if edits_of(min(len(p[0]), len(p[1])), self.edits, self.per_edit) == allowed]
            self.later.update(h for (_, _, h), ok in zip(own, within([x for x, _, _ in own], [y for _, y, _ in own], allowed)) if ok)
        self.pairs, self.chars = [], 0

    def _given(self) -> pa.RecordBatch | None:
        """The lines found since the last call."""
        later, self.later = self.later, set()
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in later], pa.int64()), pa.array([b for _, b in later], pa.int64())], names=["h_a", "h_b"]) if later else None

    def finish(self) -> pa.RecordBatch | None:
        """Verifies what is held."""
        self._verify()
        return self._given()


def _place():
    """The place of a line in the order of the corpus: null ids last, then by id, text hash and line."""
    return F.struct(F.col("rk_id").isNull().alias("no_id"), "rk_id", "rk_a", "rk_b", "line_no")


def dropped_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, per_edit: int = PER_EDIT) -> DataFrame:
    """``rk_a, rk_b, n_exact, n_near, dropped``: for each document (row key) that loses lines, which, from 0."""
    lines = written(lines_of(docs, least).distinct(), "lines-all")
    first = written(lines.groupBy("h_a", "h_b").agg(F.min(_place()).alias("at")), "lines-first")
    near = near_lines(docs, first, least, edits, per_edit).withColumn("near", F.lit(True))
    known = written(first.join(near, ["h_a", "h_b"], "left"), "lines-known")
    discard(first)
    repeated = lines.join(known, ["h_a", "h_b"]).withColumn("again", ~_place().eqNullSafe(F.col("at")))
    gone = repeated.filter(F.col("again") | F.col("near")).groupBy("rk_a", "rk_b")
    return gone.agg(
        F.count_if(F.col("again")).alias("n_exact"), F.count_if(~F.col("again")).alias("n_near"), F.sort_array(F.collect_list("line_no")).alias("dropped")
    )


def line_dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST, per_edit: int = PER_EDIT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_lines, n_exact, n_near, dropped``.

    ``dropped`` numbers (from 0) the lines that go: those of at least ``least`` characters and a word
    that equal a line earlier in the corpus (``n_exact``), or else have an earlier distinct line within
    ``edits`` edits and one edit for each ``per_edit`` characters of the shorter (``n_near``; 0: ``edits`` for
    lines of any length). Order is by ``doc_id`` (null last), then a hash of the text, then line. Rows
    that repeat id and text are one document and lose the same lines. Null and empty texts have no
    lines; further columns are ignored; an empty table gives an empty result.
    """
    gone = dropped_lines(docs, edits, least, per_edit)
    n_lines = F.when(F.length("text") > 0, F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    rows = docs.select("doc_id", *row_key(), F.coalesce(n_lines, F.lit(0)).cast("bigint").alias("n_lines"))
    out = rows.join(gone, same_key(rows, gone), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", "n_lines", zero("n_exact"), zero("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def deduped(docs: DataFrame, edits: int = EDITS, least: int = LEAST, per_edit: int = PER_EDIT) -> DataFrame:
    """``docs`` without the dropped lines (``n_chars`` follows); documents of which no word is left go.

    Null and empty texts have no lines to lose and stay as they are; ties, repeated rows and the order
    of lines are those of ``line_dedup``; columns of any other name pass through; an empty table gives
    an empty result.
    """
    gone = dropped_lines(docs, edits, least, per_edit)
    whole = docs.select(as_row(docs), *row_key())
    out = whole.join(gone, same_key(whole, gone), "left").select("row", "dropped")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(at).to_pylist()
            stays = np.ones(len(texts), bool)
            for i, lines in enumerate(batch.column(1).to_pylist()):
                if lines:
                    bad = set(lines)
                    texts[i] = "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in bad)
                    stays[i] = bool(texts[i].strip(SPACE))
            yield pa.RecordBatch.from_arrays(with_texts(batch.column(0), names, texts), names=names).filter(pa.array(stays))

    return in_tasks(out, run, docs.schema, text=0)
