"""OCR cleaning and choice over all turns, accented and null ones too, against brute force."""

import re

import pytest

from quillmatch.plans.queries import QUERIES

TURNS = [
    (1, 0, "Où est la gare, s'il vous plaît ?"), (1, 100, "plain ascii words | here"), (2, 0, "été  à la\tplage ~ naïve x"), (2, 1, None), (2, 2, ""),
    (3, 5, "Größe: ß ü über `alles` {ok}"), (12, 3, "日本 語 テキスト の 例"), (1, 1, "é"),
]


def clean(text):
    """One scan over the characters: what differs in kind from both its neighbours stays only if it is a or i."""
    line = " ".join((text or "").split())
    kinds = [False, *(c.isalnum() or c == "_" for c in line), False]
    kept = [c for i, c in enumerate(line, 1) if c in "aAiI" or kinds[i] in (kinds[i - 1], kinds[i + 1])]
    return " ".join("".join(c for c in kept if c not in "|}{~`").split())


def candidates(text):
    out = {}
    for v in range(4):
        for i, angle in enumerate((0, 90, 270)):
            rows = [(t, (len(t) * 7 + k * 3 + v * 5 + i * 11) % 97 - 3) for k, t in enumerate((text or "").split(" "))]
            rows = [(t, c) for t, c in rows if c > 0 and re.search(r"[^ \t\n\r\f\v]", t)]
            if rows:
                out[v, angle] = (" ".join(t.strip(" \t\n\r\f\v") for t, _ in rows), sum(c for _, c in rows) / len(rows))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("ocr"))
    spark.createDataFrame(TURNS, "conv_id long, turn int, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def test_clean_ocr_all(spark, folder):
    got = {x["image_id"]: x["text"] for x in QUERIES["clean_ocr"](spark, folder).collect()}
    assert got == {f"{c}/{t}": clean(x) for c, t, x in TURNS}


def test_ocr_candidates_all(spark, folder):
    got = {(x["image_id"], x["variant"], x["angle"]): (x["conf"], x["n_chars"]) for x in QUERIES["ocr_candidates"](spark, folder).collect()}
    assert got == {(f"{c}/{t}", *k): (round(conf, 6), len(raw)) for c, t, x in TURNS for k, (raw, conf) in candidates(x).items()}


def test_ocr_best_all(spark, folder):
    want = {}
    for c, t, x in TURNS:
        found = [(-conf, v, a, clean(raw)) for (v, a), (raw, conf) in candidates(x).items() if len(clean(raw)) > 5]
        conf, _, _, text = min(found, default=(0, 0, 0, ""))
        want[f"{c}/{t}"] = (text, round(-conf, 6), "vision_fallback" if -conf < 40 or len(text) < 10 else "ocr")
    assert {x["image_id"]: (x["ocr_text"], x["conf"], x["method"]) for x in QUERIES["ocr_best"](spark, folder).collect()} == want
