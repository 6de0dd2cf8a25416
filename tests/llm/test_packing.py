import random
import zlib

import numpy as np
import pytest

from quillmatch.llm.packing import Bins, Vocabulary, pack, tokenizer_path

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, piece string"


def test_ids_are_the_tokenizers():
    v = Vocabulary(tokenizer_path())
    texts = ["Hello, World's end\n\nx", None, "", " a  b\tc d\x01e <|endoftext|> it's 123 éÉ ΑΣ. ΣΑ", "x\x1cy", "日本語 ***%%% " * 50, "\x01 \x01"]
    ids, ends = v.ids(texts)
    start = 0
    for t, e in zip(texts, ends):
        assert ids[start:e].tolist() == v.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        start = e


def test_sum_of_squares_packs_tightly():
    r = random.Random(1)
    items = sorted((r.randint(1, 2048) for _ in range(4000)), reverse=True)
    bins, used = Bins(2048), {}
    for x in items:
        b, off = bins.place(x)
        assert off == used.get(b, 0)
        used[b] = off + x
    assert max(used.values()) <= 2048 and len(used) <= 1.02 * -(-sum(items) // 2048)


def test_sum_of_squares_rule():
    """Of the open sequences with room, the choice is one that makes the sum of squared counts smallest."""
    r, length = random.Random(2), 12
    bins, open_gaps = Bins(length), []
    cost = lambda gaps: sum(c * c for c in np.bincount([g for g in gaps if g], minlength=length + 1))
    gap_of = {}
    for _ in range(300):
        size = r.randint(1, length)
        open_gaps = list(gap_of.values())
        options = [cost([*open_gaps[:i], g - size, *open_gaps[i + 1 :]]) for i, g in enumerate(open_gaps) if g >= size]
        options = options or [cost([*open_gaps, length - size])]
        b, off = bins.place(size)
        gap_of[b] = length - off - size
        assert cost(list(gap_of.values())) == min(options)


def test_pieces_and_sequences(spark):
    rows = [(i, "word and other text " * (i * 7 % 400), None) for i in range(120)] + [(None, None, None), (7, "word and other text " * 49, None), (500, "a, b. " * 3000, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pack(docs, group=40, with_ids=True).collect()
    v = Vocabulary(tokenizer_path())
    whole = {}
    for r in got:
        assert r["length"] == len(r["ids"]) <= 2048 and r["start"] == 2048 * r["piece"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        whole.setdefault(r["doc_id"], {})[r["piece"]] = r["ids"]
    assert sum(len(whole[500][k]) for k in whole[500]) == len(v.tokenizer.encode(rows[-1][1], add_special_tokens=False).ids) + 1
    assert [x for k in sorted(whole[500]) for x in whole[500][k]] == v.tokenizer.encode(rows[-1][1], add_special_tokens=False).ids + [0]
    assert whole[None] == {0: [0]}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 2048
    assert pack(docs.limit(0)).count() == 0
