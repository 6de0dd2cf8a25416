import random
import zlib

import numpy as np

from quillmatch.llm import toxicity_gru as G
from quillmatch.llm.wordtable import WordTable

BAD = ["vilex", "grumbo", "snarfly"]


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("abcdehilmnost") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 120))]
        y = i % 3 == 0
        if y:
            for _ in range(1 + len(words) // 30):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "en", "s."]))
        rows.append((i, " ".join(words), int(y)))
    return rows


def test_gradient_is_that_of_the_loss():
    m = G.Model.new({"a": 1}, 1)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    words = ["a", "bc", "dEf", "x!"]
    seen = m.known(words)
    r = np.random.default_rng(0)
    at = r.integers(0, 4, (5, 6))
    mask = (np.arange(6)[None, :] < np.array([6, 4, 6, 1, 5])[:, None]).astype(float)
    owner, label = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    _, grad = G.gradient(m, seen, at, mask, owner, label)
    for k in ("W", "U", "B", "a", "o", "c"):
        flat = m.p[k].reshape(-1)
        for i in r.choice(flat.size, min(6, flat.size), replace=False):
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up, _ = G.gradient(m, seen, at, mask, owner, label)
            flat[i] = old - eps
            down, _ = G.gradient(m, seen, at, mask, owner, label)
            flat[i] = old
            assert abs((up - down) / (2 * eps) - np.asarray(grad[k]).reshape(-1)[i]) < 2e-3


def test_windows_overlap_and_cover():
    n = np.array([0, 1, 32, 33, 100])
    first, size, doc = G.windows(n)
    base = np.cumsum(n) - n
    for d, k in enumerate(n):
        own = [(f - base[d], s) for f, s, x in zip(first, size, doc) if x == d]
        assert {i for f, s in own for i in range(f, f + s)} == set(range(k))
        assert all(f + s <= k for f, s in own)


def test_held_out_accuracy(spark):
    rows = made(900, 4) + [(None, "x", 1), (5000, None, 1), (5001, "", None)]
    rows += rows[:2] + [(6000, " ".join(t for _, t, y in rows[:200] if y == 0 and t), 0), (6001, " ".join(t for _, t, y in rows[:200] if y == 0 and t) + " " + BAD[0], 1)]  # repeated rows, texts of thousands of words
    docs = spark.createDataFrame([(d, t, "clash") for d, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d != 6000 and d != 6001], "doc_id long, toxic int")
    got = G.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    truth = {d: y for d, _, y in rows if d is not None and d < 5000}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == rows[0][0]}) == 1  # repeated rows fare alike
    assert {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] in (6000, 6001)} == {6000: 0, 6001: 1}  # length alone is no evidence
    assert G.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_few_labels_are_gone_over_more_often():
    """Eighty toxic texts are enough to find others of their kind."""
    train, held = made(240, 11), made(300, 12)
    m = G.train([t for _, t, _ in train], [y for _, _, y in train])
    p = G.score_texts(m, WordTable(m.projected, 6 * G.HIDDEN), [t for _, t, _ in held]) >= 0.5
    y = np.array([y for _, _, y in held]) == 1
    assert p[y].mean() > 0.8 and (~p[~y]).mean() > 0.9


def test_one_label_only():
    m = G.train(["a b", "c"], [0, 0])
    assert (G.score_texts(m, WordTable(m.projected, 6 * G.HIDDEN), ["a", None, ""]) < 0.5).all()
