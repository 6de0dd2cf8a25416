import numpy as np

import pytest

from quillmatch.llm.embedding_lsh import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def made(seed=1):
    r = np.random.default_rng(seed)
    rows, centres = [], r.standard_normal((12, 16))
    for i in range(400):
        c = centres[i % 12] if i % 3 else r.standard_normal(16)
        rows.append((i, (c + 0.03 * r.standard_normal(16)).astype(np.float32).tolist(), int(i % 12) // 6 if i % 50 else None, "x"))
    nan = [float("nan")] + [1.0] * 15
    rows += [(900, None, 1, None), (901, [0.0] * 16, 1, None), (902, nan, 1, None), (903, [None] + [1.0] * 15, 1, None), (904, rows[5][1], rows[5][2], None), (None, rows[5][1], rows[5][2], None), (905, [1.0, 2.0], 1, None), (906, [2.0, 4.0], 1, None)]
    return rows


def brute(rows):
    def unit(v):
        if v is None or None in v:
            return None
        v = np.array(v, float)
        n = np.linalg.norm(v)
        return v / n if np.isfinite(n) and n > 0 else None

    xs = [unit(v) for _, v, _, _ in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if xs[i] is not None and xs[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(xs[i]) == len(xs[j]):
                link[i, j] = link[j, i] = xs[i] @ xs[j] >= 0.98
    return link


@pytest.mark.parametrize("block", [20, 2048])  # blocks of hot buckets at this size too
def test_links_and_components(spark, block):
    rows = made()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    link = brute(rows)
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    n = sum(r["n_links"] for r in got)
    assert 0.97 * link.sum() <= n <= link.sum()
    assert all(by[rows[i][0]]["n_links"] <= link[i].sum() for i in range(len(rows)))
    root = np.arange(len(rows))
    for _ in range(20):
        root = np.array([min([root[i], *root[link[i]]]) for i in range(len(rows))])
    same = [by[rows[i][0]]["component_id"] == rows[root[i]][0] for i in range(len(rows)) if rows[i][0] is not None]
    assert np.mean(same) > 0.98
    for v in (900, 901, 902, 903):
        assert (by[v]["n_links"], by[v]["component_id"], by[v]["kept"]) == (0, v, True)
    assert by[906]["component_id"] == 905 and not by[906]["kept"]


def test_equal_vectors_and_extremes(spark):
    """Copies count one by one; finite doubles link whatever their size."""
    big = [1e300, 2e300, -1e300]
    rows = [(i, [1.0, 2.0, 3.0], "a") for i in range(40, 10, -1)] + [(1, [1.0, 2.0, 3.0], "b"), (2, [1.0, 2.0, 3.0], None), (3, [1.0, 2.0, 3.0], None)]
    rows += [(50, big, "a"), (51, [x / 1e290 for x in big], "a"), (52, [x * 1e-320 for x in (1.0, 2.0, -1.0)], "a"), (53, [], "a"), (53, [], "a"), (54, [float("inf"), 1.0, 1.0], "a"), (54, [float("inf"), 1.0, 1.0], "a")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "'x' AS n", "'y' AS root", "'z' AS component")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    want = [(i, 29, 11, i == 11) for i in range(11, 41)] + [(i, 0, i, True) for i in (1, 2, 3, 53, 53, 54, 54)] + [(50, 2, 50, True), (51, 2, 50, False), (52, 2, 50, False)]
    assert got == sorted(want)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
