import random

import numpy as np
import pytest
import xxhash

from quillmatch.llm.simhash_vptree import block_bounds, block_of, in_shards, keep_first, links, near_duplicates, simhash, tree_links, tree_pairs, vantage_points

SCHEMA = "doc_id long, text string, lang string, fp string"


def brute_print(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(values, close):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if close(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint():
    for text in ("", None, "A b", "A B c d E", "x " * 90 + "É É", "One two\tthree\nfour five six " * 7):
        assert simhash(text) == brute_print(text)


def test_tree_finds_all_pairs():
    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 300, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x[:100] ^ np.uint64(5), x[:60] ^ np.uint64(1 << 40), x[0] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    q, p = tree_pairs(x, x, 4)
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if int(x[i] ^ x[j]).bit_count() <= 4}
    assert set(zip(q.tolist(), p.tolist())) == want


def near_fingerprints(seed, n):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 8)]
    fps = set(base)
    while len(fps) < n:
        x = r.choice(base)
        for _ in range(r.randint(1, 6)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    dense = r.getrandbits(64)  # many copies of one: they share whole blocks
    fps |= {dense ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    return sorted(x - (1 << 64) if x >> 63 else x for x in fps)


@pytest.mark.parametrize("shard,block", [(32, 16), (32, 4096), (8192, 4096)])  # many shards in blocks, many shards, one shard
def test_components_against_brute_force(spark, shard, block):
    from quillmatch.llm.grouping import components
    from quillmatch.llm.shared import written

    signed = near_fingerprints(1, 400)
    want = roots(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4)
    frame = written(spark.createDataFrame([(x,) for x in signed], "fp long"), "t")
    got = {x["node"]: x["root"] for x in components(links(frame, shard=shard, block=block), "t").collect()}
    assert all(got.get(x, x) == signed[w] for x, w in zip(signed, want))


@pytest.mark.parametrize("n", [20, 64, 65, 700])  # below and above a leaf
def test_shards_hold_every_pair(n):
    x = np.array(near_fingerprints(n, n), np.int64).view(np.uint64)
    apart = np.bitwise_count(x[:, None] ^ x[None, :])
    found = np.zeros(apart.shape, bool)
    for k, (lo, width) in enumerate(block_bounds()):
        block = block_of(x, lo, width)
        vantage, middle = vantage_points(block[: n // 2], width, 4, 1, k)
        at, shard, guest = in_shards(block, vantage, middle, 1)
        assert sorted(at[~guest]) == list(range(len(x)))
        for s in np.unique(shard):
            own, home = at[shard == s], ~guest[shard == s]
            met = home[:, None] | home[None, :]
            found[np.ix_(own, own)] |= met & (np.bitwise_count(block[own][:, None] ^ block[own][None, :]) <= 1)
            root = tree_links(block[own], x[own], np.arange(len(own)), np.flatnonzero(home), home, 1, 4)
            pairs = np.argwhere(met & (apart[np.ix_(own, own)] <= 4) & (np.bitwise_count(block[own][:, None] ^ block[own][None, :]) <= 1))
            assert (root[pairs[:, 0]] == root[pairs[:, 1]]).all()
            assert all(root[i] == i or apart[np.ix_(own, own)][i, np.arange(len(own)) != i].min() <= 4 for i in range(len(own)))
    assert found[apart <= 4].all()


def test_rows(spark):
    a = " ".join(f"w{i}" for i in range(300))
    rows = [(3, a, "en", None), (1, a.upper().lower() + "", "de", None), (2, a + " tail", None, None), (9, None, None, None), (8, " \n", None, None), (7, "other text altogether and more", None, None), (7, "other text altogether and more", None, None), (None, a, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x)
    assert all(x["fingerprint"] == f"{brute_print(t):016x}" for d, t, *_ in rows for x in by[d][:1] if d is not None)
    ids = sorted(d for d, *_ in rows if d is not None)
    text = {d: t for d, t, *_ in rows}
    want = dict(zip(ids, (ids[k] for k in roots([brute_print(text[d]) for d in ids], lambda x, y: (x ^ y).bit_count() <= 4))))
    assert {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None} == want
    stay = sorted(x["doc_id"] for x in keep_first(docs).collect())
    assert stay == sorted(set(want.values())) and keep_first(docs).columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_first(docs.limit(0)).count() == 0
