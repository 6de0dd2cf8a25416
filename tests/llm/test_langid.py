import random
import zlib

import numpy as np

from quillmatch.llm.langid_mixture import languages, mixtures

SOUNDS = {"en": ["the", "ing", "tion", "and", "er"], "de": ["ung", "sch", "keit", "ein", "ß"], "fr": ["eau", "eux", "oi", "é", "ment"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_held_out_and_mixtures(spark):
    r = random.Random(2)
    rows = [(i, text(r, lang := r.choice(list(SOUNDS)), r.randint(3, 60)), lang, 1) for i in range(600)]
    rows += [(1000, None, "en", 1), (1001, "123 456 !", "de", 1), (None, text(r, "fr", 20), None, 1), (1002, text(r, "en", 100) + " " + text(r, "de", 60), None, 1), (rows[0][0], rows[0][1], rows[0][2], 1)]
    got = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")).collect()
    assert len(got) == len(rows)
    lang = {d: x for d, _, x, _ in rows if d is not None and d < 1000}
    held = [x for x in got if x["held_out"] and x["doc_id"] in lang]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got if x["doc_id"] is not None)
    assert np.mean([x["lang_pred"] == lang[x["doc_id"]] for x in held]) > 0.97
    by = {x["doc_id"]: x for x in got}
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == "und" and by[None]["lang_pred"] == "fr"
    assert by[1002]["lang_pred"] == "en" and by[1002]["n_langs"] == 2 and 0.5 < by[1002]["score"] < 0.8


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert languages(empty).count() == 0
    assert languages(spark.createDataFrame([(1, "abc", None)], empty.schema)).first()["lang_pred"] == "und"


def test_expectation_maximisation_raises_the_likelihood():
    r = np.random.default_rng(1)
    p = r.random((50, 3)).astype(np.float32)
    doc = np.sort(r.integers(0, 4, 50))
    last = -np.inf
    for rounds in (1, 3, 9):
        like = mixtures(p, doc, 5, rounds=rounds)[1].sum()
        assert like >= last - 1e-3
        last = like
