"""Exact dedup: verdicts against a plain loop, and the index across deliveries and sessions of its own."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from quillmatch.llm.digest_index import DigestIndex, digested, exact_dedup

SCHEMA = "doc_id long, text string, n long, keep_mark string, digest string"


def plain(rows):
    body = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, (d, t, *_) in enumerate(rows):
        groups.setdefault(body(t), []).append((d if d is not None else float("-inf"), i))
    out = []
    for i, (d, t, *_) in enumerate(rows):
        group = groups[body(t)]
        top = max(group)
        out.append((d, rows[top[1]][0], len(group), hashlib.sha256(body(t).encode()).hexdigest()))
    return out, len(groups)


@pytest.mark.parametrize("buckets", [1, 5])
def test_against_a_loop(spark, buckets):
    texts = [None, "", "A b", "a B", "ab", "Äx", "äx", "long " * 30000, "LONG " * 30000, " a b", "K", "k", "K"]
    rows = [(i, texts[i * 7 % len(texts)], 1, "x", "y") for i in range(200)] + [(9, "A b", 2, None, None)] * 3 + [(None, "only me", 1, None, None)] * 2 + [(None, "k", 1, None, None), (-5, "neg", 1, None, None)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), buckets=buckets).collect()
    want, groups = plain(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_empty(spark):
    got = exact_dedup(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_index_is_kept_and_read_in_place(spark, tmp_path):
    rows = lambda lo, hi: digested(spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))).withColumn("mark", F.monotonically_increasing_id())
    path = f"{tmp_path}/index"
    index = DigestIndex(spark, path, 4)
    index.ingest(rows(0, 100), "a")
    index.ingest(rows(50, 200), "b")
    index.ingest(rows(50, 200), "b")  # again, as after a failure
    assert {r["delivery"]: r["count"] for r in index.entries().groupBy("delivery").count().collect()} == {"a": 100, "b": 100}
    index.close()
    again = DigestIndex(spark, path, 4)
    again.ingest(rows(150, 260), "c")
    assert again.entries().count() == 260 and again.entries().select("digest").distinct().count() == 260
    new = rows(0, 1).groupBy("digest").agg(F.max("doc_id").alias("m"))
    plan = new.join(again.entries().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    small = again.compact(f"{path}-{uuid.uuid4().hex}")
    assert sorted(map(tuple, small.entries().drop("delivery").collect())) == sorted(map(tuple, again.entries().drop("delivery").collect()))


def test_native(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")
    for df in (digested(docs), exact_dedup(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
