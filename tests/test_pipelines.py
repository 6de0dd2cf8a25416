import json

import pytest
from pyspark.sql import functions as F

from quillmatch.functions.jsonx import analysis, error_of, extract_json, valid_analysis
from quillmatch.operators import display
from quillmatch.operators import lookup as lk
from quillmatch.operators import store
from quillmatch.operators.match import fit
from quillmatch.plans import pipelines
from quillmatch.sources import pixels, providers
from quillmatch.streaming import enrich
from tests.test_match import parts  # noqa: F401


def test_json(spark):
    cases = {
        'x ```json\n{"a": 1}\n``` y': '{"a": 1}', '```\n{"a": 2}```': '{"a": 2}', ' {"a": 3} ': '{"a": 3}', 'so {"a": {"b": 4}} it is': '{"a": {"b": 4}}', "none": "{}", "{bad": "{}",
        "```json\nno``` {\"a\":1}": "{}", None: "{}",
    }
    for reply, want in cases.items():
        assert spark.createDataFrame([(reply,)], "r string").select(extract_json(F.col("r")).alias("j")).first()["j"] == want
    row = lambda j: spark.createDataFrame([(j,)], "j string").select(analysis(F.col("j"), F.lit("asked")).alias("a"), valid_analysis(F.col("j")).alias("ok"), error_of(F.col("j")).alias("e")).first()
    full = row('{"brand_name": null, "uses": ["u"], "confidence": "0.5"}')
    assert full["ok"] and full["a"]["brand_name"] is None and full["a"]["uses"] == ["u"] and full["a"]["warnings"] == [] and full["a"]["confidence"] == 0.5 and full["e"] is None
    assert row("{}")["a"]["brand_name"] == "asked" and not row('{"uses": null}')["ok"] and row('{"error": "e"}')["e"] == "e"


def test_search(spark, parts):  # noqa: F811
    asked = spark.createDataFrame([(1, " Alphacet 650 ", "en-US"), (2, "  ", None)], "qid long, name string, target_language string")
    got = {r["qid"]: r for r in pipelines.search(asked, *parts, providers.stub_analysis).collect()}
    data = got[1]["data"]
    assert got[1]["success"] and data["brand_name"] == "Alphacet 650" and data["method"] == "text_search" and data["nppa_ceiling_price"] == "12" and data["price_flag"] == "ok" and data["price"] == "10.5"
    assert data["cheaper_alternatives"][0]["name"] == "Paracetamol Tablets IP 650mg"
    assert not got[2]["success"] and got[2]["data"] is None
    failed = pipelines.search(asked, *parts, providers.unconfigured).filter("qid = 1").first()
    assert not failed["success"] and failed["error"] == "no model is configured"


def test_analyze(spark, parts):  # noqa: F811
    images = spark.createDataFrame([("a", b"Gammapan 40 Tablet"), ("b", b"x")], "image_id string, content binary")
    got = {r["image_id"]: r for r in pipelines.analyze(images, providers.stub_words, *parts, providers.stub_analysis, providers.stub_analysis).collect()}
    assert got["a"]["data"]["method"] == "ocr" and got["a"]["data"]["ocr_text"] == "Gammapan40Tablet" and got["a"]["data"]["price_flag"] == "missing"
    assert got["b"]["data"]["method"] == "vision_fallback" and got["b"]["data"]["cheaper_alternatives"] == [] and got["b"]["data"]["price"] == ""


def test_chat(spark):
    asked = spark.createDataFrame([(1, "s", "hello", "hi-IN"), (2, "s", "hello", "en-US"), (3, "gone", "x", "en-US")], "request_id long, scan_id string, message string, target_language string")
    contexts = spark.createDataFrame([("s", '{"x":1}', [("user", "before")])], "scan_id string, context string, history array<struct<role:string,content:string>>")
    got = {r["request_id"]: r for r in pipelines.chat(asked, contexts, providers.stub_analysis, providers.stub_translation).collect()}
    assert set(got) == {1, 2} and got[1]["reply"].startswith("[hi-IN] ") and got[2]["reply"].startswith("```json") and got[2]["prompt"][1:] == ["user: before", "user: hello"]


def test_provider_failure_is_an_answer(spark):
    def broken():
        def answer(frame):
            raise RuntimeError("down")

        return answer

    rows = spark.createDataFrame([(1,)], "id long")
    assert json.loads(providers.ask(rows, broken, "r", on_error=providers.error_json).first()["r"]) == {"error": "down"}
    with pytest.raises(Exception, match="down"):
        providers.ask(rows, broken, "r").collect()


def test_display(spark):
    rows = spark.createDataFrame([(1, "", "g", "ok", "ocr", 0.255, ["a", '{"name":"n"}', '{"x":1}'], [])], "id long, brand_name string, generic_name string, price_flag string, method string, confidence double, uses array<string>, warnings array<string>")
    assert tuple(rows.select(*display.header()).first()) == ("g", "fair", "ocr", "26%")
    assert [r["item"] for r in display.sections(rows, "id", ("uses", "warnings")).orderBy("item_no").collect()] == ["a", "n", '{"x":1}']


def test_streams(spark, tmp_path):
    index = fit(spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, t string"), "id", "t")
    spark.createDataFrame([(1, "alpha x"), (2, "betta")], "qid long, query string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("qid long, query string").parquet(f"{tmp_path}/in")
    enrich.match_stream(stream, index, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted((r["qid"], r["doc_id"]) for r in spark.read.parquet(f"{tmp_path}/out").filter("rank = 1").collect()) == [(1, 1), (2, 2)]
    spark.createDataFrame([("a", i * 100, f"2024-01-01 00:0{i}:00") for i in range(8)], "endpoint string, response_time_ms long, created_at string").selectExpr("endpoint", "response_time_ms", "timestamp(created_at) created_at").write.parquet(f"{tmp_path}/m")
    metrics = spark.readStream.schema("endpoint string, response_time_ms long, created_at timestamp").parquet(f"{tmp_path}/m")
    q = enrich.latency_windows(metrics).writeStream.outputMode("complete").format("memory").queryName("lat").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.sql("select n from lat").collect()) == [3, 5]
    assert lk.BRANDED["price"] == ("price(₹)", "")


def test_images_by_their_pixels(spark):
    """The reader gets the twelve turned variants of what decodes; the rest has no reading."""

    def reader():
        return lambda frame: [[{"word_idx": 0, "text": f"{w}x{h} seen", "conf": 50.0 + 10 * (a == 90)}] for w, h, a in zip(frame["width"], frame["height"], frame["angle"])]

    images = spark.createDataFrame([("a", b"P5 30 20 255\n" + bytes(range(200)) * 3), ("b", b"junk")], "image_id string, content binary")
    got = {r["image_id"]: (r["ocr_text"], r["ocr_confidence"]) for r in pipelines.read_images(images, reader, lambda x: pixels.image_variants(x, even=pixels.evened)).collect()}
    assert got == {"a": ("20x30seen", 60.0), "b": ("", 0.0)}


def test_second_translation(spark):
    texts = spark.createDataFrame([(1, "hello", "hi-IN"), (2, "hello", "en-US"), (3, "  ", "hi-IN"), (4, "hola", "ta-IN")], "text_id long, text string, language string")
    blank = lambda: lambda frame: [" " if lang == "ta-IN" else f"[{lang}] {t}" for lang, t in zip(frame["language"], frame["chunk"])]
    second = lambda: lambda frame: [f" second: {p[-4:]}" if p.strip().endswith("hola") else "" for p in frame["prompt"]]
    got = {r["text_id"]: r["translation"] for r in pipelines.translated(texts, blank, second).collect()}
    assert got == {1: "[hi-IN] hello", 2: "hello", 3: "[hi-IN]   ", 4: "second: hola"}


def test_strict_results(spark):
    rows = spark.createDataFrame([("1", '{"a":1}'), ("2", "{bad"), ("3", "")], "id string, result_json string")
    assert store.scan_by_id(rows, "1").select(F.to_json("result_json")).first()[0] == '{"a":1}' and store.scan_by_id(rows, "9").count() == 0
    assert store.scan_by_id(rows, "3").select(F.to_json("result_json")).first()[0] == "{}"
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        store.scan_by_id(rows, "2").collect()
