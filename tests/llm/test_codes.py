"""Vector codes against plain Python on integers of any size."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from quillmatch.llm.vector_codes import compressed

SCHEMA = "vec_id long, embedding array<double>, label string, n int, key string, code string"


def plain(rows, parts=16, entries=64, rounds=2):
    good = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(-(-max((len(v) for _, v, _ in good), default=0) // parts), 1) * parts
    step = width // parts
    cut = []
    for i, v, lab in good:
        q = [math.floor(Fraction(x) * 256) for x in v] + [0] * (width - len(v))
        cut.append((i, [q[p * step : (p + 1) * step] for p in range(parts)], lab))
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, good[k][1]))[:entries]
    books = [[list(cut[k][1][p]) for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(q[p], e), c) for c, e in enumerate(books[p])) for p in range(parts)] for _, q, _ in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for c in range(len(books[p])):
                own = [cut[k][1][p] for k in range(len(cut)) if found[k][p][1] == c]
                if own:
                    books[p][c] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    most = (1 << 63) - 1
    capped = [min(e, most) for e in errors]
    by = {}
    for (_, _, lab), e in zip(cut, capped):
        by[lab] = by.get(lab, 0) + e
    return [(i, "".join(f"{c:02x}" for _, c in f), e, min(by[lab], most), sha) for (i, _, lab), f, e in zip(cut, found, capped)]


def same(spark, rows, **how):
    got = compressed(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows)))


@pytest.mark.parametrize("block", [7, 4096])
def test_against_plain_python(spark, block):
    r = np.random.default_rng(5)
    bad = [None, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] * 32]
    rows = [(i * 7 % 211, (r.standard_normal(32) * 0.2).tolist(), ["a", "b", None][i % 3], 1, "k", "c") for i in range(211)]
    rows += [(500 + i, v, "a", 1, None, None) for i, v in enumerate(bad)] + [rows[3]] * 3 + [(None, rows[9][1], None, 1, None, None), (-1, [0.0] * 32, "z", 1, None, None)]
    same(spark, rows, block=block)


def test_odd_lengths_and_sizes(spark):
    """Lengths that the parts don't divide, empty vectors, few vectors, components of any size."""
    rows = [(1, [], "a", 1, "", ""), (2, [1.0] * 5, "a", 1, "", ""), (3, [0.5] * 17, None, 1, "", ""), (4, [-1e-300] * 20, "b", 1, "", "")]
    same(spark, rows)
    same(spark, rows + [(0, [1e6, -1e300] + [1.7e308] * 3, "b", 1, "", ""), (5, [70000.0] * 3, None, 1, "", ""), (6, [1e308], "a", 1, "", "")])
    same(spark, [(1, [3e13] + [0.0] * 15, "a", 1, "", ""), (2, [-3e13] + [0.1] * 15, "a", 1, "", "")])


def test_more_rows_than_entries_of_a_few_vectors(spark):
    same(spark, [(i, [float(i % 3)] * 16, "a", 1, "", "") for i in range(150)])


def test_floats_and_empty(spark):
    got = compressed(spark.createDataFrame([(1, [0.1, 0.2], 3)], "vec_id int, embedding array<float>, label int")).collect()
    assert len(got) == 1 and got[0]["error"] == 0 and got[0]["code"] == "00" * 16
    assert compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert compressed(spark.createDataFrame([(1, None, "a", 1, "", "")], SCHEMA)).count() == 0
