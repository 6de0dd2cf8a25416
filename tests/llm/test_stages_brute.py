"""The pipeline's stages against plain Python, with columns of clashing names, and on an empty table."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillmatch.llm.line_edit_join import _distance
from quillmatch.llm.packing import Vocabulary, tokenizer_path
from quillmatch.llm.quality_lines import DEPLETED, LEAST_DOCS, MOST_SHARE
from tests.llm.test_copies import brute as near_brute
from tests.llm.test_quality import brute_repeat

CLASH = ("target", "rest", "source_size", "taken", "mx_size", "mx_hash", "rk_id", "rk_a", "rk_b", "rk_nth", "q_kept", "q_lines", "ld_dropped", "row", "at", "copy", "dropped", "frequent", "kept", "fp", "uid", "n", "u", "root", "a b.c")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    r = random.Random(12)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(r.randint(8, 20)))
    menu = "Home About and other words of the menu bar"
    rows = []
    for i in range(70):
        lines = [line() for _ in range(r.randint(2, 5))]
        if i % 2 == 0:
            lines.insert(0, menu)
        rows.append((i, "\n".join(lines), "en", f"s{i // 2 % 2}" if i % 13 else None, 1))
    rows += [(100 + i, f"{menu}\nab {i}", "en", "s0", 1) for i in range(6)]  # depleted
    rows += [(200, rows[5][1], "en", "s1", 1), (201, rows[7][1] + " tail", "en", "s2", 1), (202, rows[8][1].replace("a", "b", 1), "en", "s1", 1), (300, None, None, None, None), (301, "", "en", "s1", 0), (302, "too short", "en", "s1", 9)]
    return rows


def quality(rows):
    norm = lambda x: " ".join(re.sub("[0-9]", "0", x.lower()).split())
    texts = {}
    for _, t, _, s, _ in rows:
        texts.setdefault(s, set()).add(t)
    bad = {}
    for s, own in texts.items():
        seen = [{norm(x) for x in (t or "").split("\n")} for t in own]
        bad[s] = {x for x in set().union(*seen) if x and (n := sum(x in y for y in seen)) > LEAST_DOCS and n > MOST_SHARE * len(own)}
    out = []
    for d, t, lang, s, n in rows:
        words = (t or "").split()
        frequent = [x for x in (t or "").split("\n") if norm(x) in bad[s]]
        if len(words) >= 10 and 100 * brute_repeat(words) <= 20 * len(words) and sum(len(x.split()) for x in frequent) <= DEPLETED * len(words):
            kept = "\n".join(x for x in t.split("\n") if x not in frequent)
            out.append((d, kept, lang, s, len(kept) if frequent else n))
    return out


def lines(rows):
    seen, out = [], []
    for d, t, *_ in sorted(rows):
        keep = []
        for x in t.split("\n"):
            again = x.strip() and any(x == y or abs(len(x) - len(y)) <= 2 and _distance(x, y) <= min(2, len(x) // 15, len(y) // 15) for y in seen)
            keep += [] if again else [x]
            seen.append(x)
        if "".join(keep).strip():
            out.append((d, "\n".join(keep)))
    return out


def goals(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, todo, left = {}, set(names), 1.5 * sum(size.values())
    while todo:
        total = sum(weight[s] for s in todo)
        over = {s for s in todo if left * weight[s] / total > 2 * size[s]}
        for s in over or todo:
            goal[s] = 2 * size[s] if over else left * weight[s] / total
        left -= sum(goal[s] for s in over)
        todo = todo - over if over else set()
    return goal


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.createDataFrame(made(), SCHEMA)
    docs = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASH])
    docs.write.parquet(f"{at}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{at}/empty/documents.parquet")
    return str(at)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert docs.columns == columns
        rows = docs.collect()
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASH), name
        kept.append(sorted((r["doc_id"], r["text"]) for r in rows))
    first = quality(made())
    assert kept[0] == sorted((d, t) for d, t, *_ in first)
    assert not {*range(100, 106), 300, 301, 302} & {d for d, _ in kept[0]} and sum("menu" in t for _, t in kept[0]) < 10  # depleted, failed, removed
    assert kept[1] == sorted(lines(first))
    ids = near_brute([(d, t, None) for d, t in kept[1]])
    assert [d for d, _ in kept[2]] == ids
    source, words = {d: s for d, _, _, s, _ in made()}, {d: len(t.split()) for d, t in kept[2]}
    size = {}
    for d, n in words.items():
        size[source[d]] = size.get(source[d], 0) + n
    for s, goal in goals(size).items():
        took = [d for d, _ in kept[3] if source[d] == s]
        assert abs(sum(words[d] for d in took) - goal) <= max(words.values()) and max(map(took.count, took)) <= 2
    vocabulary, sequences = Vocabulary(tokenizer_path()), {}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(r["doc_id"] for r in out if r["piece"] == 0) == [d for d, _ in kept[3]]
    text = dict(kept[3])
    for r in out:
        ids = np.array(vocabulary.tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids + [0], "<u4")[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and len(ids) == r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 2048 and sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) for own in sequences.values())


def test_run_on_an_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0
