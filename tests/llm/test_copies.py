import random

import corpus_pipeline
from quillmatch.llm import shingle_copies as M
from quillmatch.llm.shingle_copies import keep_first_similar

SCHEMA = "doc_id long, text string, extra string"


def brute(rows, least=0.8):
    """Ids that stay: the smallest of each component of distinct ids."""

    def own(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = sorted((d, own(t)) for d, t, _ in rows)
    root = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b) and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if k == y else k for k in root]
    return sorted(sets[i][0] for i in set(root))


def copies(r, n):
    """Texts and copies with some words changed: similarities from 0.6 to 1."""
    rows = []
    for d in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 300))]
        rows.append((d, " ".join(words), None))
        for k in range(3):
            other = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 30))):
                other[r.randrange(len(other))] = f"x{r.randrange(5000)}"
            rows.append((1000 + 10 * d + k, " ".join(other), None))
    return rows


def test_stage_against_brute_force(spark, monkeypatch):
    rows = copies(random.Random(7), 40)
    rows += [(5000, None, None), (5001, " ", None), (5002, "", None), (5003, "two words", None), (5004, "Two  words", None), (5005, "two others", None)]
    want = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(x["doc_id"] for x in got.collect()) == want and got.columns == docs.columns
    monkeypatch.setattr(M, "BLOCK", 2)  # shards in blocks too
    assert sorted(x["doc_id"] for x in keep_first_similar(docs).collect()) == want


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text, None), (7, text + " tail", None), (7, text + " tail", None), (9, "alone here", "x"), (9, "alone here", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, keep_first_similar(docs).collect())) == [(7, text + " tail", None), (9, "alone here", "x")]
    assert keep_first_similar(docs.limit(0)).count() == 0
