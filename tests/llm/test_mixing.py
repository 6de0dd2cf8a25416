import re

from quillmatch.llm.mixing import mix, mixed_documents

SCHEMA = "doc_id long, source string, text string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        goal = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if goal[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return capped | goal
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = [(i, f"s{(i * i) % 11}" if i % 17 else None, "w " * (i % 90), "clash") for i in range(600)]
    rows += [(1000, "s1", "big " * 5000, None), (1001, "empty", None, None), (None, "s2", "a b c", None), (5, rows[5][1], rows[5][2], None)]
    got = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    again = mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    sizes = {}
    for d, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    src = {(d, len(WORD.findall(t or ""))): s for d, s, t, _ in rows}
    goal, taken = brute_targets(sizes), {}
    for r in got:
        s = src[(r["doc_id"], r["size"])]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 3 for s in goal)


def test_documents_come_as_often_as_taken(spark):
    rows = [(i, f"s{i % 4}", "w " * (10 + i % 5), None) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mix(docs).collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(abs(times.get(d, 0) - x) <= 0.5 for d, x in taken.items())


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix(spark.createDataFrame([(1, None, None, None)], SCHEMA)).collect()[0]["taken"] == 0
