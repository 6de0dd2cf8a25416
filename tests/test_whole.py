"""Queries over whole texts, which no SQL is given for, against brute force on small tables."""

import math
import re
from collections import Counter

import pytest

from quillmatch.plans.queries import QUERIES

LONG = "the quick brown fox jumps over a lazy dog and then walks home along the river bank in the evening "
PASSAGE = "zebra crossings are painted in white and black stripes so that drivers notice them early enough to stop"
DOCS = [(1, LONG * 2 + PASSAGE), (2, LONG * 3), (3, " " * 45 + "late"), (4, " \n" * 30), (5, None), (6, PASSAGE), (7, "Été à la plage: " + LONG)]
ASKED = [(10, PASSAGE), (11, LONG[:70] + PASSAGE), (12, "nothing of it 123")]


def norm(text):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", (text or "").lower())).strip()


def counts(text):
    return Counter(f" {w} "[i : i + n] for w in norm(text).split() for n in (2, 3, 4) for i in range(len(w) + 3 - n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ASKED, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_knn_documents(spark, folder):
    tf = {d: counts(t) for d, t in DOCS}
    df = Counter(g for x in tf.values() for g in x)
    idf = {g: math.log((1 + len(DOCS)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(c):
        w = {g: n * idf[g] for g, n in c.items() if g in idf}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / length for g, x in w.items()}

    want = {}
    for q, text in ASKED:
        a = unit(counts(text))
        found = sorted((-round(s, 6), d, s) for d, c in tf.items() if (s := sum(x * unit(c).get(g, 0) for g, x in a.items())) > 0.1)
        want |= {(q, r): (d, s) for r, (_, d, s) in enumerate(found[:5], 1)}
    got = {(x["qid"], x["rank"]): (x["doc_id"], x["match_score"]) for x in QUERIES["knn_documents"](spark, folder).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == d and abs(got[k][1] - s) < 0.00051 for k, (d, s) in want.items())
    assert {d for (q, _), (d, _) in got.items() if q == 10} >= {1, 6}  # beyond the first 60 characters of 1


def test_required_fields(spark, folder):
    assert {x["doc_id"]: x["ok"] for x in QUERIES["required_fields"](spark, folder).collect()} == {d: bool((t or "").strip()) for d, t in DOCS}
