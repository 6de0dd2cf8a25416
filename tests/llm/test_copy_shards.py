import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import shingle_copies as M
from quillmatch.llm.shared import written
from quillmatch.llm.simhash_vptree import in_shards, tree_links, vantage_points

from tests.llm.test_copies import SCHEMA, brute, copies


def pair(r, n, common):
    """Two sets of ``n`` hashes of which ``common`` are in both."""
    x = r.integers(0, 2**64, 2 * n - common, np.uint64, endpoint=False)
    return np.unique(x[:n]), np.unique(x[n - common :])


@pytest.mark.parametrize("n,common", [(9, 8), (45, 40), (450, 400)])  # a similarity of 0.8
def test_shards_bring_copies_together(n, common):
    r = np.random.default_rng(n)
    sets = [s for _ in range(1000) for s in pair(r, n, common)]
    words = np.array([M.signature(s) for s in sets])
    apart = np.bitwise_count(words[0::2] ^ words[1::2]).sum(axis=1) / (64 * M.WORDS)
    assert 0.1 < apart.mean() < 0.17
    met = np.zeros(len(sets) // 2, bool)
    for k in range(M._TREES):
        value = M.block_of(words, k)
        at, shard, guest = in_shards(value, *vantage_points(value, M.WIDTH, 3, M.REACH, k), M.REACH)
        assert sorted(at[~guest]) == list(range(len(sets))) and len(np.unique(shard)) > 4
        for s in np.unique(shard):
            own, home = at[shard == s], ~guest[shard == s]
            root = tree_links(value[own].astype(np.uint16), words[own, : M.CHECKED], np.arange(len(own)), np.flatnonzero(home), home, M.REACH, M.FAR)
            of = dict(zip(own.tolist(), root.tolist()))
            met |= [2 * i in of and of.get(2 * i + 1) == of[2 * i] for i in range(len(met))]
            assert (own[root] // 2 == own // 2).all()  # unrelated sets are far apart
    assert met.sum() >= len(met) - 1


def test_candidates_in_small_shards_and_cells(spark):
    import random

    rows = copies(random.Random(11), 30)
    docs = spark.createDataFrame(rows, SCHEMA)
    at = F.struct(F.col("rk_id").isNull().alias("no_id"), "rk_id", "rk_a", "rk_b", "n", "words")
    one = written(M.prints(docs).groupBy("uid").agg(F.min(at).alias("at")), "t")
    id_of = {x["uid"]: x["id"] for x in one.select("uid", F.col("at.rk_id").alias("id")).collect()}
    want = None
    for shard, cell in ((M.SHARD, M.CELL), (16, M.CELL), (16, 8), (200, 32)):
        got = {id_of[x["node"]]: x["root"] for x in M.candidates(one, shard=shard, cell=cell).collect()}
        groups = sorted(sorted(d for d in got if got[d] == root) for root in set(got.values()))
        want = want or groups
        assert groups == want and all(len(g) > 1 for g in groups)
    assert len(brute(rows)) < len(id_of)
