"""The end-to-end pipelines: text search, image analysis, chat. Each is one plan over a batch of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.jsonx import analysis, error_of, extract_json, valid_analysis
from quillmatch.functions.text import or_default, strip
from quillmatch.operators import lookup as lk
from quillmatch.operators import ocr, translate
from quillmatch.operators.store import chat_prompt
from quillmatch.sources.providers import WORD_LIST, ask, ask_once, error_json


def analysis_prompt(text: Column, found: Column, language: Column) -> Column:
    """What a text model is asked: the text, the lookup if any, and the language to answer in."""
    block = F.when(found.isNotNull(), F.concat(F.lit("\n\nCatalogue lookup:\n"), F.to_json(found, {"pretty": "true", "ignoreNullFields": "false"}))).otherwise("")
    answer_in = F.when(language != "en-US", F.concat(F.lit("\n\nGive every text value in the language "), language, F.lit("; keep the JSON keys."))).otherwise("")
    return F.concat(F.lit("Text on the package:\n\n"), text, block, answer_in)


def _respond(rows: DataFrame, brand_default: Column | None, text: Column, method: Column) -> DataFrame:
    """``rows(reply)`` with ``json, error, data``: the analysis of a reply, or why there is none. A reply without JSON is an empty success."""
    rows = rows.withColumn("json", extract_json(F.col("reply")))
    rows = rows.withColumn("error", F.coalesce(error_of(F.col("json")), F.when(~valid_analysis(F.col("json")), F.lit("a list field of the reply is not a list"))))
    data = analysis(F.col("json"), brand_default)
    return rows.withColumn("data", F.when(F.col("error").isNull(), data.withField("ocr_text", text).withField("method", method)))


def _with_prices(info: Column, generic_matches: Column) -> Column:
    price, ceiling, flag = lk.enriched(F.lit(""), info)
    return F.col("data").withField("price", price).withField("nppa_ceiling_price", ceiling).withField("price_flag", flag).withField("cheaper_alternatives", lk.alternatives(generic_matches))


def _envelope(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.col("error").isNull().alias("success"), "data", "error")


def search(requests: DataFrame, names: lk.Catalogue, subs: lk.Catalogue, prices: lk.Catalogue, model: Callable, replies: str | None = None) -> DataFrame:
    """``requests(qid, name, target_language)`` to ``qid, success, data, error``. A blank name is an error.

    With ``replies``, a shared folder, the model is asked once for equal prompts and what it said is kept there.
    """
    asked = requests.select("qid", strip(F.coalesce("name", F.lit(""))).alias("query"), F.coalesce("target_language", F.lit("en-US")).alias("language"))
    blank = asked.filter("query = ''")
    asked = asked.filter("query <> ''")
    found = lk.lookup(asked.select("qid", "query"), names, subs, prices).drop("query")
    rows = asked.join(found, "qid")
    context = F.struct("branded_matches", "generic_alternatives", "master_matches", "price_info")
    rows = rows.withColumn("subject", F.col("query")).withColumn("prompt", analysis_prompt(F.concat(F.lit("Product name: "), F.col("query")), context, F.col("language")))
    rows = ask_once(rows, model, "reply", ["prompt", "subject"], replies, error_json) if replies else ask(rows, model, "reply", on_error=error_json)
    rows = _respond(rows, F.col("query"), F.col("query"), F.lit("text_search"))
    rows = rows.withColumn("data", _with_prices(F.col("price_info"), F.col("generic_alternatives")))
    out = _envelope(rows, "qid")
    none = blank.select("qid", F.lit(False).alias("success"), F.lit(None).cast(out.schema["data"].dataType).alias("data"), F.lit("a name is required").alias("error"))
    return out.unionByName(none)


def read_images(images: DataFrame, reader: Callable, variants: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``image_id, ocr_text, ocr_confidence`` of ``images(image_id, content)`` by the best of twelve readings.

    With ``variants`` (``pixels.image_variants``, which evens out contrast and noise first) the reader gets the pixels of each variant, turned, and
    images that don't decode have no reading; without, it gets the content and the variant and angle to apply.
    """
    tries = variants(images) if variants else ocr.candidates(images.sparkSession, images.select("image_id", "content"))
    words = ask(tries, reader, "words", WORD_LIST).select("image_id", "variant", "angle", F.inline("words"))
    return ocr.best_text(images, words)


def analyze(images: DataFrame, reader: Callable, names: lk.Catalogue, subs: lk.Catalogue, prices: lk.Catalogue, text_model: Callable, vision_model: Callable, language: str = "en-US", variants: Callable | None = None) -> DataFrame:
    """``images(image_id, content)`` to ``image_id, success, data, error``.

    Readable images are looked up and analysed by their text, and looked up once more by the name that
    the analysis found, for prices and alternatives; the others go to the vision model and get neither.
    """
    read = read_images(images, reader, variants).persist().withColumn("method", ocr.route(F.col("ocr_confidence"), F.col("ocr_text")))
    by_text, by_sight = read.filter("method = 'ocr'"), read.filter("method <> 'ocr'")
    first = lk.lookup(by_text.select(F.col("image_id").alias("qid"), F.col("ocr_text").alias("query")), names, subs, prices)
    rows = by_text.join(first.withColumnRenamed("qid", "image_id").drop("query"), "image_id")
    context = F.struct("branded_matches", "generic_alternatives", "master_matches", "price_info")
    rows = rows.select("image_id", "ocr_text", "method", F.col("ocr_text").alias("subject"), analysis_prompt(F.col("ocr_text"), context, F.lit(language)).alias("prompt"))
    # The model is asked once; the second lookup reads its answers.
    rows = _respond(ask(rows, text_model, "reply", on_error=error_json).persist(), None, F.col("ocr_text"), F.col("method"))
    again = rows.select(F.col("image_id").alias("qid"), or_default(F.col("data.brand_name"), or_default(F.col("data.generic_name"), F.col("ocr_text"))).alias("query"))
    second = lk.lookup(again, names, subs, prices).select(F.col("qid").alias("image_id"), "generic_alternatives", "price_info")
    rows = rows.join(second, "image_id", "left").withColumn("data", _with_prices(F.col("price_info"), F.col("generic_alternatives")))
    seen = by_sight.join(images.select("image_id", "content"), "image_id").withColumn("subject", F.lit(""))
    seen = _respond(ask(seen, vision_model, "reply", on_error=error_json), None, F.col("ocr_text"), F.col("method"))
    blank = [F.lit("").alias(n) for n in ("price", "nppa_ceiling_price", "price_flag")]
    data = F.col("data")
    for c, n in zip(blank, ("price", "nppa_ceiling_price", "price_flag")):
        data = data.withField(n, c)
    seen = seen.withColumn("data", data.withField("cheaper_alternatives", F.array().cast("array<struct<name:string,price:string,source:string,drug_code:string>>")))
    return _envelope(rows, "image_id").unionByName(_envelope(seen, "image_id"))


def translated(texts: DataFrame, translator: Callable, second: Callable) -> DataFrame:
    """``text_id, translation`` of ``texts(text_id, text, language)``: by the translation models, piece by piece.

    A text of which they return nothing goes to a second, text model as a whole; what that fails on stays as it is.
    """
    parts = ask(translate.pieces(texts), translator, "translation").persist()  # the models are asked once
    nothing = parts.groupBy("text_id").agg(F.max(strip(F.coalesce("translation", F.lit("")))).alias("most")).filter("most = ''").select("text_id")
    done = translate.joined(texts, parts).join(nothing, "text_id", "left_anti")
    rest = texts.join(nothing, "text_id", "left_semi")
    asked = ask(rest.withColumn("prompt", translate.prompt(F.col("text"), F.col("language"))), second, "translation", on_error=lambda e: "")
    return done.unionByName(asked.select("text_id", or_default(strip(F.col("translation")), F.col("text")).alias("translation")))


def chat(requests: DataFrame, contexts: DataFrame, model: Callable, translator: Callable, system: str = "You answer questions about this product:\n") -> DataFrame:
    """``requests(request_id, scan_id, message, target_language)`` with ``contexts(scan_id, context, history)`` to ``request_id, prompt, reply``.

    The message goes to the model as it is; only the reply is translated. Unknown scans get no reply.
    """
    rows = requests.join(contexts, "scan_id")
    rows = rows.withColumn("prompt", chat_prompt(F.concat(F.lit(system), F.col("context")), F.col("history"), F.col("message")))
    rows = rows.select("request_id", "prompt", F.coalesce("target_language", F.lit("en-US")).alias("language"), F.col("message").alias("subject"))
    rows = ask(rows, model, "reply", on_error=lambda e: f"Something went wrong with this question. Please try again. ({e})")
    texts = rows.select(F.col("request_id").alias("text_id"), F.col("reply").alias("text"), "language")
    done = ask(translate.pieces(texts), translator, "translation")
    final = translate.joined(texts, done)
    return rows.select("request_id", "prompt").join(final.select(F.col("text_id").alias("request_id"), F.col("translation").alias("reply")), "request_id")
