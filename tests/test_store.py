import datetime as dt

from pyspark.sql import functions as F

from quillmatch.operators import ocr, store
from quillmatch.sources import catalogues, tables

T0 = dt.datetime(2024, 1, 1)


def scans(spark):
    shapes = ['{"brand_name":"X","generic_name":"y"}', '{"success":true,"data":{"brand_name":"X"},"error":null}', '{"success":false,"data":null,"error":"e"}', '{"brand_name":""}', None, "", "{bad"]
    rows = [(f"s{i}", "u1" if i < 7 else None, f"{i}.png", j, "", 0.5, "ocr", T0) for i, j in enumerate([*shapes, shapes[0]])]
    return spark.createDataFrame(rows, "id string, user_id string, image_path string, result_json string, ocr_text string, ocr_confidence double, method string, created_at timestamp_ntz")


def test_history(spark):
    page = store.history_page(scans(spark), "u1").collect()
    assert [r["id"] for r in page] == [f"s{i}" for i in range(7)]  # equal times: by id
    assert [r["brand_name"] for r in page] == ["X"] + ["Unknown"] * 6 and page[0]["image_url"] == "/uploads/0.png"
    assert [r["brand_name"] for r in store.history_page(scans(spark), "u1", parity=False).collect()][:2] == ["X", "X"]
    assert store.history_page(scans(spark), None).count() == 0
    for limit, offset, want in [(-1, 0, 7), (2, -40, 2), (-5, 2, 5), (0, 0, 0)]:
        assert store.history_page(scans(spark), "u1", limit, offset).count() == want
    assert store.pagination(scans(spark), 3).first().asDict() == {"user_id": "u1", "total": 7, "pages": 3}


def test_chat_prompt_sees_messages_11_to_20(spark):
    rows = [("a", i, "user", f"m{i}", T0) for i in range(1, 26)] + [("b", i, "user", f"n{i}", T0) for i in range(1, 4)]
    messages = spark.createDataFrame(rows, "scan_id string, id long, role string, content string, created_at timestamp_ntz")
    got = store.message_window(messages).orderBy("scan_id", "pos").collect()
    assert [r["id"] for r in got if r["scan_id"] == "a"] == list(range(11, 21)) and [r["id"] for r in got if r["scan_id"] == "b"] == [1, 2, 3]
    context = store.chat_context(spark.createDataFrame([("a", ""), ("c", '{"x":1}')], "id string, result_json string"), messages)
    prompt = {r["scan_id"]: r["p"] for r in context.select("scan_id", store.chat_prompt(F.col("context"), F.col("history"), F.lit("q")).alias("p")).collect()}
    assert prompt["a"] == ["{}", *[f"user: m{i}" for i in range(11, 21)], "user: q"] and prompt["c"] == ['{"x":1}', "user: q"]


def test_changes(spark):
    users = spark.createDataFrame([("a@x", 1)], "email string, id long")
    new = spark.createDataFrame([("a@x", 2), ("b@x", 4), ("b@x", 3), (None, 5)], "email string, id long")
    assert sorted(map(tuple, store.insert_absent(users, new, "email", "id").collect())) == [("a@x", 1), ("b@x", 3)]
    messages = spark.createDataFrame([("s1", 1), ("s2", 2)], "scan_id string, id long")
    left, kept = store.cascade_delete(scans(spark), messages, spark.createDataFrame([("s1",), ("none",)], "id string"))
    assert left.count() == 7 and [r["scan_id"] for r in kept.collect()] == ["s2"]
    assert store.orphans(messages, "scan_id", scans(spark), "id").count() == 0
    assert store.repeated_keys(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), "k").count() == 2
    ok, bad = store.required(spark.createDataFrame([("a", " "), ("b", "c")], "x string, y string"), "x", "y")
    assert ok.count() == bad.count() == 1


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    tables.create(spark, root)
    rows = store.scan_rows(spark.createDataFrame([("1", None, " n ", None, "{}")], "id string, user_id string, name string, data_json string, response_json string"), image=False)
    tables.append(rows, root, "scans")
    tables.create(spark, root)
    row = tables.read(spark, root, "scans").first()
    assert (row["ocr_text"], row["method"], row["ocr_confidence"], row["result_json"]) == ("n", "text_search", 1.0, "{}") and row["created_at"].microsecond == 0
    tables.append(store.message_rows(spark.createDataFrame([("1", "hi", None), ("1", "hi", "yo")], "scan_id string, message string, reply string")), root, "chat_messages")
    assert tables.read(spark, root, "chat_messages").groupBy("role").count().orderBy("role").collect()[0]["count"] == 1
    left, _ = store.cascade_delete(tables.read(spark, root, "scans"), tables.read(spark, root, "chat_messages"), spark.createDataFrame([("1",)], "id string"))
    tables.replace(left, root, "scans")
    assert tables.read(spark, root, "scans").count() == 0


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,name,price(₹),x\n1,"A, ""q""\nline2",5,z\n2,B\n3,C,,"",9\n\n4,"",1,2\n', encoding="utf-8")
    got = catalogues.read_csv(spark, str(tmp_path / "x.csv")).orderBy("doc_id").drop("doc_id").collect()
    assert list(map(tuple, got)) == [("1", 'A, "q"\nline2', "5", "z"), ("2", "B", "", ""), ("3", "C", "", ""), ("4", "", "1", "2")]
    loaded = catalogues.load(spark, str(tmp_path / "nowhere"))
    assert {r["catalogue"]: r["n"] for r in catalogues.row_counts(loaded).collect()} == {"generics": 0, "branded": 0, "master": 0}


def test_images(spark, tmp_path):
    for name, size in (("a.PNG", 3), ("b.txt", 3), ("c.jpg", 0), ("d.jpeg", 11 * 1024 * 1024)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert [r["path"].rsplit("/", 1)[1] for r in catalogues.images(spark, str(tmp_path)).collect()] == ["a.PNG"]


def test_ocr(spark):
    rows = [("i1", 0, 0, i, t, c) for i, (t, c) in enumerate([("Alphacet", 90.0), ("650", 80.0), (" ", 95.0), ("junk", -1.0)])]
    rows += [("i1", 0, 90, 0, "Alphacet", 85.0), ("i1", 0, 90, 1, "Tab", 85.0), ("i2", 0, 0, 0, "abc", 99.0)]
    words = spark.createDataFrame(rows, "image_id string, variant int, angle int, word_idx int, text string, conf double")
    images = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "image_id string")
    got = ocr.best_text(images, words).withColumn("m", ocr.route(F.col("ocr_confidence"), F.col("ocr_text"))).orderBy("image_id").collect()
    assert list(map(tuple, got)) == [("i1", "Alphacet650", 85.0, "ocr"), ("i2", "", 0.0, "vision_fallback"), ("i3", "", 0.0, "vision_fallback")]
    assert ocr.candidates(spark, images).count() == 36


def test_latency_is_exact(spark):
    times = [(e, (i * i * 37 + i) % 200_003 + shift) for e, n, shift in (("a", 20_001, 0), ("b", 11, -100_000), (None, 2, 5_000_000_000)) for i in range(n)]
    rows = [*times, ("a", None), ("none", None), ("one", 7)]
    metrics = spark.createDataFrame(rows, "endpoint string, response_time_ms long")
    cont, disc = ({r["endpoint"]: tuple(r)[1:] for r in store.latency(metrics, between).collect()} for between in (True, False))
    assert set(cont) == set(disc) == {"a", "b", None, "none", "one"}
    for e in cont:
        own = sorted(t for x, t in rows if x == e and t is not None)
        n = sum(x == e for x, _ in rows)
        if not own:
            assert cont[e] == disc[e] == (n, None, None, None)
            continue
        assert disc[e] == (n, own[-(-len(own) // 2) - 1], own[-(-len(own) * 95 // 100) - 1], own[-1])
        for got, p in zip(cont[e][1:3], (0.5, 0.95)):
            at = (len(own) - 1) * p
            lo = own[int(at)]
            assert abs(got - (lo + (own[min(int(at) + 1, len(own) - 1)] - lo) * (at - int(at)))) < 1e-6
