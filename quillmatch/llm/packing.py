"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.shared import cache_of, in_tasks, slices, written

LENGTH = 2048  #: Tokens of a sequence.
GROUP = 20_000  #: Pieces that are packed with each other.
BATCH = 4_000_000  #: Bytes of text that are tokenised at once.
WORDS = 400_000  #: Words whose ids a worker keeps at hand; beyond that it starts anew.


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary(dict):
    """Words to their place in a table of token ids, filled as words turn up.

    The tokenizer never joins across spaces, so the ids of a text are those of its words.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[""] = 0  # no ids
        self["\n"] = 1  # the end of a document: id 0 (no word holds a line feed)
        self.pending: list[str] = []
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 1
        self.start = np.zeros(1 << 15, np.int64)
        self.count = np.zeros(1 << 15, np.int64)
        self.count[1] = 1
        self.known = 2

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.pending.append(word)
        return at

    def _add(self, ids: list[int]) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        if self.known >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.known], self.count[self.known] = self.used, len(ids)
        self.used += len(ids)
        self.known += 1

    def learn(self) -> None:
        """Ids of the words that are pending: many to a call, with a mark between them."""
        for at in range(0, len(self.pending), 4096):
            some = self.pending[at : at + 4096]
            if any(self.MARK in w for w in some):
                for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                    self._add(x.ids)
                continue
            runs = [some[i : i + 64] for i in range(0, len(some), 64)]
            for run, x in zip(runs, self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(r) for r in runs], add_special_tokens=False)):
                ids, n = x.ids, len(self.mark)
                if n == 1:
                    cuts = [i for i, t in enumerate(ids) if t == self.mark[0]]
                    if len(cuts) == len(run) - 1:
                        for a, b in zip([-1, *cuts], [*cuts, len(ids)]):
                            self._add(ids[a + 1 : b])
                        continue
                for y in self.tokenizer.encode_batch_fast(run, add_special_tokens=False):
                    self._add(y.ids)
        self.pending = []

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with id 0 after it, and where each text ends."""
        if len(self) > WORDS:
            self.forget()
        get = self.__getitem__
        words: list[int] = []
        ends = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words.extend(map(get, text.replace("\n", " ").split(" ")))
            words.append(1)
            ends[i] = len(words)
        self.learn()
        at = np.array(words, np.int64)
        count = self.count[at]
        total = np.cumsum(count)
        shift = np.repeat(self.start[at] - (total - count), count)
        return self.flat[np.arange(len(shift)) + shift], total[ends - 1] if len(texts) else ends


def _vocabulary(path: str) -> Vocabulary:
    held = cache_of("packing")
    if path not in held:
        held[path] = Vocabulary(path)
    return held[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """``row_id, doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document, cut only where it is too long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        vocabulary = _vocabulary(path)
        for batch in slices(batches, 2, BATCH):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, ends = vocabulary.ids(part.column("text").to_pylist())
                ids = ids.astype("<u4", copy=False)
                row, piece, start, size, crc, out = [], [], [], [], [], []
                begin = 0
                for i, end in enumerate(ends.tolist()):
                    for n, a in enumerate(range(begin, end, length)):
                        b = min(a + length, end)
                        row.append(i)
                        piece.append(n)
                        start.append(a - begin)
                        size.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].data))
                        if with_ids:
                            out.append(ids[a:b].astype(np.int32))
                    begin = end
                take = pa.array(row, pa.int64())
                columns = [part.column("row_id").take(take), part.column("doc_id").take(take), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, size, crc))]
                names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"row_id bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)


class Bins:
    """Open sequences by residual gap; each piece goes where the sum of squared counts becomes smallest.

    A new sequence is opened only when no open one has room: with the largest pieces first that comes
    within a sequence or two of the lower bound, while the plain rule, which may open one at any time,
    leaves up to half a percent more.
    """

    def __init__(self, length: int):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)  # open sequences of each gap
        self.open: dict[int, list[int]] = defaultdict(list)
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """The sequence that takes ``size`` tokens, and the place in it. Ties go to the smallest gap."""
        n, length = self.counts, self.length
        before = n[size:]
        # Moving a sequence from gap g to g - size adds 2 n(g-size) - 2 n(g) + 2; a full one no longer counts.
        grows = 2 * (n[: length + 1 - size] - before) + 2
        grows[0] = 1 - 2 * before[0]
        grows = np.where(before > 0, grows, np.iinfo(np.int64).max)
        best = int(np.argmin(grows))
        if before[best]:
            gap = best + size
            bin_id = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, bin_id = length, self.made
            self.made += 1
        left = gap - size
        if left:
            n[left] += 1
            self.open[left].append(bin_id)
        return bin_id, length - gap


def packed(found: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``found`` (pieces) with ``sequence_id`` and ``offset``.

    Pieces are dealt by a hash to groups of about ``group``, each packed in one task, largest pieces
    first; what a group leaves open is the tail of a few sequences among thousands.
    """
    n = found.count()
    groups = max(1, round(n / group))
    dealt = found.withColumn("pack", F.pmod(F.xxhash64("row_id", "piece"), F.lit(groups)).cast("int"))
    kept = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = -1, Bins(length)
        for batch in batches:
            seq, off = [], []
            for g, size in zip(batch.column("pack").to_pylist(), batch.column("length").to_pylist()):
                if g != now:
                    now, bins = g, Bins(length)
                s, o = bins.place(size)
                seq.append((g << 40) + s)
                off.append(o)
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    ordered = dealt.repartition(groups, "pack").sortWithinPartitions("pack", F.desc("length"), "row_id", "piece")
    return ordered.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece of every row of ``docs(doc_id, text)``.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked). A
    document is its token ids and one id 0; a null text is an empty one. Only documents longer than
    ``length`` are cut, into pieces of ``length`` and a rest. Every row stands for itself, repeated
    or with a null id; further columns are ignored; an empty table gives an empty result.
    """
    found = written(pieces(docs, path or tokenizer_path(), length, with_ids), "pack-pieces")
    return packed(found, length, group).drop("row_id")
