"""Queries over the driver's tables, one or more for each operator; ``oracle.py`` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.functions import text as tx
from quillmatch.functions.jsonx import analysis, error_of, extract_json, has_key, opens, stored_field, stored_field_anywhere, valid_analysis
from quillmatch.operators import block_search, display, ocr, store, translate
from quillmatch.operators import lookup as lk
from quillmatch.operators.match import MatchIndex, fit, fit_stored, term_counts
from quillmatch.plans import pipelines
from quillmatch.sources import catalogues, pixels, providers, scratch, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stand-ins for the catalogues and operational tables.


def branded_rows(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"), F.col("p_brand").alias("manufacturer_name"),
        F.lit("part").alias("type"), F.col("p_size").cast("string").alias("pack_size_label"), F.col("p_type").alias("short_composition1"), F.col("p_brand").alias("short_composition2"),
    )


def generic_rows(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(
        F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_type", "p_brand").alias("Generic Name"), F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("MRP"),
        F.concat("p_size", F.lit("'s")).alias("Unit Size"), F.col("p_type").alias("Group Name"),
    )


def master_rows(spark: SparkSession, d: str) -> DataFrame:
    """Market price: the mean unit price in ``lineitem``; the flag compares it with the retail price (an extension: it is data elsewhere)."""
    unit = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("market"))
    rows = table(spark, d, "part").join(unit, "p_partkey", "left").withColumn("ratio", F.col("market") / F.col("p_retailprice"))
    return rows.select(
        F.col("p_partkey").alias("doc_id"), tx.normalise(F.col("p_name")).alias("brand_clean"), F.col("p_type").alias("canonical_inn"), F.col("p_type").alias("composition_raw"),
        F.col("p_brand").alias("manufacturer"), F.lit("False").alias("is_generic"), F.coalesce(F.rint("market").cast("bigint").cast("string"), F.lit("")).alias("product_price"),
        F.rint("p_retailprice").cast("bigint").cast("string").alias("nppa_price"),
        F.when(F.col("ratio").isNull(), "missing").when(F.col("ratio") > 1, "overpriced").otherwise("ok").alias("price_flag"), F.lit("").alias("ratio_market_to_nppa"),
    )


def name_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50, its name without the last two characters, against all rows."""
    part = table(spark, d, "part").filter("p_partkey % 50 = 0")
    return part.select(F.col("p_partkey").alias("qid"), F.expr("substring(p_name, 1, length(p_name) - 2)").alias("query"))


def scans(spark: SparkSession, d: str) -> DataFrame:
    """``orders`` as scans with every shape of stored result."""
    o = table(spark, d, "orders")
    shape = F.pmod("o_orderkey", F.lit(6))
    flat = F.to_json(F.struct(F.col("o_orderpriority").alias("brand_name"), F.col("o_orderstatus").alias("generic_name")))
    wrapped = F.concat(F.lit('{"success":true,"data":'), flat, F.lit(',"error":null}'))
    json = F.when(shape == 0, flat).when(shape == 1, wrapped).when(shape == 2, '{"success":false,"data":null,"error":"e"}').when(shape == 3, '{"brand_name":""}').when(shape == 4, "{bad")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.pmod("o_orderkey", F.lit(10)) != 0, F.col("o_custkey").cast("string")).alias("user_id"),
        F.concat("o_orderkey", F.lit(".png")).alias("image_path"), json.alias("result_json"), F.col("o_orderstatus").alias("ocr_text"),
        (F.col("o_totalprice") / 1000000).alias("ocr_confidence"), F.lit("ocr").alias("method"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("scan_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """Words of all turns of ``conversations`` as twelve readings an image, with confidences from plain arithmetic."""
    tries = ocr.candidates(spark, all_turns(spark, d))
    w = tries.select("image_id", "variant", "angle", "angle_idx", F.posexplode(F.split("text", " ")).alias("word_idx", "text"))
    conf = F.pmod(F.length("text") * 7 + F.col("word_idx") * 3 + F.col("variant") * 5 + F.col("angle_idx") * 11, F.lit(97)) - 3
    return w.select("image_id", "variant", "angle", "word_idx", "text", conf.cast("double").alias("conf"))


def all_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of ``conversations`` as an image of its own, under a key of conversation and turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return table(spark, d, "conversations").select(F.concat(part("conv_id"), F.lit("/"), part("turn")).alias("image_id"), "text")


# Matching and lookup.


@query
def normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalise(F.col("text")).alias("n"))


@query
def term_frequencies(spark, d):
    return term_counts(branded_rows(spark, d).select("doc_id", tx.normalise(F.col("name")).alias("n")), "doc_id")


@query
def inverse_document_frequencies(spark, d):
    return fit(branded_rows(spark, d), "doc_id", "name").idf.select("gram", (F.rint(F.col("idf") * 1e6) / 1e6).alias("idf"))


@query
def knn_branded(spark, d):
    return lk.branded(branded_rows(spark, d)).search(name_queries(spark, d), 5)


@query
def knn_generics(spark, d):
    asked = table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_type", "p_brand").alias("query"))
    return lk.generics(generic_rows(spark, d)).search(asked, 5)


@query
def knn_master(spark, d):
    return lk.master(master_rows(spark, d)).search(name_queries(spark, d), 3)


@query
def knn_documents(spark, d):
    """Every whole benchmark passage against all whole documents."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return block_search.top_k(block_search.fit(table(spark, d, "documents"), "doc_id", "text"), asked, 5)


def _catalogues(spark, d):
    return lk.catalogues(stored=True, branded=branded_rows(spark, d), generics=generic_rows(spark, d), master=master_rows(spark, d))


def _looked_up(spark, d):
    return lk.lookup(name_queries(spark, d), *_catalogues(spark, d))


@query
def lookup(spark, d):
    """The composite lookup as rows: which part, at what place, what and how close."""
    item = lambda label, name: lambda m, at: F.struct(F.lit(label).alias("part"), (at + 1).cast("bigint").alias("rank"), m[name].alias("name"), m["match_score"].alias("match_score"))
    parts = [("branded_matches", "branded", "name"), ("generic_alternatives", "generic", "generic_name"), ("master_matches", "master", "brand_name")]
    return _looked_up(spark, d).select("qid", F.inline(F.concat(*[F.transform(c, item(label, name)) for c, label, name in parts])))


@query
def price_info(spark, d):
    return _looked_up(spark, d).select("qid", F.col("price_info.product_price").alias("product_price"), F.col("price_info.nppa_ceiling_price").alias("ceiling"), F.col("price_info.price_flag").alias("flag"))


@query
def alternatives(spark, d):
    rows = _looked_up(spark, d).select("qid", F.posexplode(lk.alternatives(F.col("generic_alternatives"))).alias("at", "a"))
    return rows.select("qid", F.col("at").cast("bigint").alias("at"), "a.name", "a.price", "a.source", "a.drug_code")


@query
def enrichment(spark, d):
    """Prices merged into an analysis: even queries come with a price of their own."""
    own = F.when(F.pmod("qid", F.lit(100)) == 0, F.lit("1")).otherwise("")
    return _looked_up(spark, d).select("qid", *lk.enriched(own, F.col("price_info")))


# Stored results.


@query
def history_pages(spark, d):
    return store.history_pages(scans(spark, d), 5, 1).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query
def history_corrected(spark, d):
    return scans(spark, d).select("id", stored_field_anywhere(F.col("result_json"), "brand_name", "Unknown").alias("brand_name"))


@query
def history_page_of_user(spark, d):
    page = store.history_page(scans(spark, d), "7", limit=3, offset=2)
    return page.select("id", "image_url", "brand_name", "generic_name", "confidence", "method")


@query
def history_of_nobody(spark, d):
    return store.history_page(scans(spark, d), None).select("id")


@query
def pagination(spark, d):
    return store.pagination(scans(spark, d), 20)


@query
def page_parameters(spark, d):
    p, n, o = store.page_numbers(F.col("o_orderpriority"), F.concat("o_orderstatus", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", p.alias("page"), n.alias("page_size"), o.alias("skipped"))


@query
def chat_first_messages(spark, d):
    return store.message_window(messages(spark, d), 4, None).select("scan_id", "id", "role", "pos")


@query
def chat_window(spark, d):
    return store.message_window(messages(spark, d), 4, 2).select("scan_id", "id", "role", "pos")


@query
def chat_window_full(spark, d):
    return store.message_window(messages(spark, d), 20, 10).select("scan_id", "id", "role", "pos")


@query
def chat_prompts(spark, d):
    context = store.chat_context(scans(spark, d), messages(spark, d))
    prompt = store.chat_prompt(F.concat(F.lit("context "), F.col("context")), F.col("history"), F.lit("and now?"), 3)
    return context.select("scan_id", F.array_join(prompt, "\n").alias("prompt"))


@query
def upsert_users(spark, d):
    users = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.lower("c_name").alias("email"), F.col("c_custkey").alias("id"))
    logins = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.lower("c_name").alias("email"), (F.col("o_orderkey") + 1000000).alias("id"))
    return store.insert_absent(users, logins, "email", "id")


def _deleted(spark, d):
    ids = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("id"))
    return store.cascade_delete(scans(spark, d), messages(spark, d), ids)


@query
def delete_scans(spark, d):
    return _deleted(spark, d)[0].select("id")


@query
def delete_messages(spark, d):
    return _deleted(spark, d)[1].select("scan_id", F.col("id").alias("turn"))


@query
def orphan_messages(spark, d):
    """Messages whose scan is not there: scans are the orders that are not urgent."""
    left = scans(spark, d).join(table(spark, d, "orders").filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("id")), "id", "left_semi")
    return store.orphans(messages(spark, d), "scan_id", left, "id").select("scan_id", F.col("id").alias("turn"))


@query
def repeated_keys(spark, d):
    return store.repeated_keys(table(spark, d, "part"), "p_name")


@query
def bad_roles(spark, d):
    return store.bad_roles(messages(spark, d)).groupBy("role").agg(F.count("*").alias("n"))


@query
def append_searches(spark, d):
    rows = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.lit(None).cast("string").alias("user_id"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"),
        F.when(F.col("p_size") > 25, F.to_json(F.struct(F.col("p_brand").alias("brand_name")))).alias("data_json"), F.lit('{"success":false}').alias("response_json"),
    )
    return store.scan_rows(rows, image=False).drop("created_at")


@query
def append_images(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("user_id"), F.col("p_name").alias("name"), F.to_json(F.struct("p_size")).alias("response_json"))
    return store.scan_rows(rows, image=True).drop("created_at")


@query
def append_messages(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("scan_id"), F.col("text").alias("message"), F.when(F.col("role") == "assistant", F.col("role")).alias("reply"))
    return store.message_rows(turns).drop("created_at")


def _requests(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("endpoint"), F.col("ts").alias("started"), (F.col("ts") + F.expr("make_interval(0,0,0,0,0,0,cast(pmod(event_id, 90) as decimal(18,6)))")).alias("ended"), (F.col("value") > 10).alias("succeeded"))


@query
def append_metrics(spark, d):
    return store.metric_rows(_requests(spark, d)).drop("created_at")


@query
def latency(spark, d):
    return store.latency(store.metric_rows(_requests(spark, d)))


@query
def required_fields(spark, d):
    ok, bad = store.required(table(spark, d, "documents").select("doc_id", "text"), "text")
    return ok.select("doc_id", F.lit(True).alias("ok")).unionByName(bad.select("doc_id", F.lit(False).alias("ok")))


# One scan, one reply.


@query
def scan_by_id(spark, d):
    one = store.scan_by_id(scans(spark, d), "7")
    return one.select("id", "user_id", "image_path", F.try_variant_get("result_json", "$.data.brand_name", "string").alias("brand_name"), "ocr_text", "ocr_confidence", "method")


@query
def stored_results_that_open(spark, d):
    return scans(spark, d).select("id", opens(F.col("result_json")).alias("opens"))


@query
def scan_responses(spark, d):
    shape = "struct<success:boolean,data:struct<brand_name:string>,error:string>"
    rows = scans(spark, d).withColumn("result", F.coalesce(F.from_json("result_json", shape), F.from_json(F.lit("{}"), shape)))
    return store.response(rows, image=True).select("scan_id", "image_url", "success", F.col("data.brand_name").alias("brand_name"), "error")


@query
def chat_replies(spark, d):
    c = table(spark, d, "conversations")
    reply, other = F.when(F.col("role") == "assistant", F.col("text")).otherwise(""), F.when(F.col("turn") % 2 == 0, F.col("role"))
    return c.select("conv_id", "turn", store.reply_of(reply, other).alias("reply"), store.shown_reply(other, reply, F.lit(""), "no reply").alias("shown"))


@query
def bearer_tokens(spark, d):
    header = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Bearer "), F.translate("p_name", " ", "-"))).when(F.col("p_size") % 3 == 0, "Bearer ").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", tx.bearer_token(header).alias("token"))


# JSON.


def _replies(spark, d):
    """Model replies around the JSON of ``events``: fenced, bare, in prose, broken, with an error."""
    props = F.col("props")
    kind = F.pmod("event_id", F.lit(5))
    reply = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\nDone."))).when(kind == 1, props).when(kind == 2, F.concat(F.lit("It is "), props, F.lit(" as asked.")))
    return table(spark, d, "events").select("event_id", reply.when(kind == 3, F.lit("no json { here")).otherwise(F.lit('{"error": "busy"}')).alias("reply"))


@query
def extracted_json(spark, d):
    rows = _replies(spark, d).withColumn("json", extract_json(F.col("reply")))
    return rows.select("event_id", F.get_json_object("json", "$.k").try_cast("bigint").alias("k"), error_of(F.col("json")).alias("error"), has_key(F.col("json"), "k").alias("has_k"))


@query
def analysis_defaults(spark, d):
    p = table(spark, d, "part")
    json = F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.col("p_brand").alias("brand_name"), F.array("p_type").alias("uses")))).otherwise(F.lit('{"uses": null, "confidence": 0.5}'))
    rows = p.withColumn("json", json).withColumn("a", analysis(F.col("json"), F.col("p_name")))
    return rows.select("p_partkey", F.col("a.brand_name").alias("brand_name"), F.col("a.form").alias("form"), F.array_join("a.uses", ",").alias("uses"), F.size("a.warnings").cast("bigint").alias("n_warnings"), F.col("a.confidence").alias("confidence"), valid_analysis(F.col("json")).alias("valid"))


@query
def stored_names(spark, d):
    return scans(spark, d).select("id", stored_field(F.col("result_json"), "brand_name", "Unknown").alias("brand_name"), stored_field(F.col("result_json"), "generic_name", "").alias("generic_name"))


# OCR.


@query
def clean_ocr(spark, d):
    return all_turns(spark, d).select("image_id", tx.clean_ocr(F.col("text")).alias("text"))


@query
def ocr_candidates(spark, d):
    return ocr.texts(words(spark, d)).select("image_id", "variant", "angle", (F.rint(F.col("conf") * 1e6) / 1e6).alias("conf"), F.length("raw").cast("bigint").alias("n_chars"))


@query
def ocr_best(spark, d):
    best = ocr.best_text(all_turns(spark, d), words(spark, d))
    return best.select("image_id", "ocr_text", (F.rint(F.col("ocr_confidence") * 1e6) / 1e6).alias("conf"), ocr.route(F.col("ocr_confidence"), F.col("ocr_text")).alias("method"))


@query
def image_sizes(spark, d):
    p = table(spark, d, "part").withColumn("w", F.col("p_size") * 100).withColumn("h", F.col("p_partkey").cast("int") % 3000 + 1)
    w, h = ocr.rotated_size(F.col("w"), F.col("h"), F.lit(0))
    return p.select("p_partkey", (F.rint(ocr.scale(F.col("w"), F.col("h")) * 1e6) / 1e6).alias("scale"), w.alias("rotated_w"), h.alias("rotated_h"))


@query
def acceptable_uploads(spark, d):
    files = table(spark, d, "pages").select(F.concat("url", F.element_at(F.array(*map(F.lit, [".PNG", ".jpg", ".gif", ""])), (F.col("page_id") % 4 + 1).cast("int"))).alias("path"), (F.length("html") * (F.col("page_id") % 5000)).cast("bigint").alias("length"))
    return catalogues.acceptable(files)


@query
def uploads(spark, d):
    """The new names of accepted files: one each, none twice, with the extension kept."""
    files = table(spark, d, "pages").select(F.concat("url", F.when(F.col("page_id") % 2 == 0, ".PNG").otherwise(".txt")).alias("path"), F.length("html").cast("bigint").alias("length"))
    named = store.uploads(files)
    return named.agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"), F.count_distinct("upload_id").alias("n_ids"), F.count_if(F.length("upload_id") == 36).alias("n_uuids"), F.count_if(F.endswith("name", F.lit(".PNG"))).alias("n_kept"))


# Translation and display.


def _texts(spark, d):
    code = F.when(F.col("lang") == "en", "en-US").when(F.col("lang") == "de", "hi-IN").when(F.col("lang") == "fr", "ta-IN").otherwise("xx-XX")
    return table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text", code.alias("language"))


@query
def translation_pieces(spark, d):
    return translate.pieces(_texts(spark, d)).select("text_id", "model", F.col("piece").cast("bigint").alias("piece"), "chunk")


@query
def translations(spark, d):
    """Pieces come back in upper case; every third one fails."""
    texts = _texts(spark, d)
    done = translate.pieces(texts).withColumn("translation", F.when(F.col("piece") % 3 != 2, F.concat(F.lit("<"), "chunk", F.lit(">"))))
    return translate.joined(texts, done)


@query
def translation_prompts(spark, d):
    return _texts(spark, d).filter("language <> 'en-US'").select("text_id", translate.prompt(F.col("text"), F.col("language")).alias("prompt"))


@query
def localised_strings(spark, d):
    """Nations ask for strings; regions below 3 have them, the others get region 0's."""
    strings = table(spark, d, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("locale"), F.lit("title").alias("key"), F.col("r_name").alias("value"))
    asked = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("locale"))
    return translate.localised(asked, strings, 0)


@query
def result_header(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("brand_name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")).alias("generic_name"),
        F.when(F.col("p_size") > 25, "overpriced").when(F.col("p_size") > 10, "ok").otherwise("missing").alias("price_flag"),
        F.when(F.col("p_size") % 5 == 0, "vision_fallback").otherwise("ocr").alias("method"), ((F.col("p_size") - 1) / 50.0).alias("confidence"),
    )
    return rows.select("p_partkey", *display.header())


@query
def result_sections(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.array("p_brand", F.to_json(F.struct(F.col("p_type").alias("name"))))).otherwise(F.array().cast("array<string>")).alias("uses"), F.array("p_name").alias("warnings"))
    return display.sections(rows, "p_partkey", ("uses", "warnings")).withColumn("item_no", F.col("item_no").cast("bigint"))


@query
def catalogue_counts(spark, d):
    return catalogues.row_counts({"branded": branded_rows(spark, d), "generics": generic_rows(spark, d), "master": master_rows(spark, d)})


# Tables on disk: written from the driver's tables, read back and changed in place.


@query
def knn_stored(spark, d):
    """The branded search by an index that was saved and is loaded again."""
    path = scratch.new_path(spark, "branded-index")
    rows = branded_rows(spark, d)
    fit_stored({"branded": (rows, "doc_id", "name")}, path)
    return lk.Catalogue(lk.project(rows, lk.BRANDED), MatchIndex.load(spark, path), "branded").search(name_queries(spark, d), 5)


def _csv_folder(spark, d):
    """The three catalogues as CSV files: with quoted line feeds and doubled quotes in names, blank cells, and two headers missing."""
    root = scratch.new_path(spark, "catalogues")
    write = lambda df, name: df.write.options(header=True, escape='"', emptyValue="").csv(f"{root}/{catalogues.FILES[name][0]}")
    part = table(spark, d, "part")
    odd = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(' "new",\nimproved'))).otherwise(F.col("p_name"))
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    write(part.select(odd.alias("name"), F.when(F.col("p_size") > 10, price).alias("price"), F.col("p_brand").alias("manufacturer_name"), F.col("p_type").alias("short_composition1"), F.lit("").alias("short_composition2")), "branded")
    write(part.select(F.concat_ws(" ", "p_type", "p_brand").alias("Generic Name"), price.alias("MRP"), F.col("p_size").alias("Unit Size"), F.col("p_type").alias("Group Name")), "generics")
    write(part.select(odd.alias("brand_raw"), F.col("p_name").alias("canonical_inn"), price.alias("nppa_price")), "master")
    return root


@query
def csv_catalogues(spark, d):
    """Every cell of the three files as it comes back, with what stands in for missing headers."""
    loaded = catalogues.load(spark, _csv_folder(spark, d))
    flat = lambda name, *columns: lk.project(loaded[name], lk.KINDS[name][0]).select(F.lit(name).alias("catalogue"), *[F.col(c).alias(o) for c, o in zip(columns, "abcd")])
    rows = flat("branded", "name", "price", "composition1", "is_discontinued").unionByName(flat("generics", "generic_name", "mrp", "unit_size", "category"))
    return rows.unionByName(flat("master", "brand_name", "canonical_name", "nppa_price", "product_price"))


@query
def csv_search(spark, d):
    """Searches in a loaded file: rows are numbered anew, so matches are told by their names; its text is the canonical name, as one header is missing."""
    loaded = catalogues.load(spark, _csv_folder(spark, d))
    return lk.master(loaded["master"]).search(name_queries(spark, d), 1).select("qid", "canonical_name", "match_score")


@query
def csv_counts(spark, d):
    """Rows of each file; a file that is not there is an empty catalogue."""
    root = _csv_folder(spark, d)
    return catalogues.row_counts(catalogues.load(spark, root) | {"absent": catalogues.load(spark, f"{root}/nowhere")["branded"]})


def _stored_tables(spark, d):
    """Operational tables of the orders and conversations: created, appended to, created again."""
    root = scratch.new_path(spark, "operational")
    tables.create(spark, root)
    tables.append(scans(spark, d), root, "scans")
    tables.append(messages(spark, d), root, "chat_messages")
    customers = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'")
    tables.append(customers.select(F.col("c_custkey").cast("string").alias("id"), F.lower("c_name").alias("email"), F.col("c_name").alias("name")), root, "users")
    tables.create(spark, root)
    return root


@query
def stored_scans(spark, d):
    """Scans of a table on disk, and their messages, after deleting some scans."""
    root = _stored_tables(spark, d)
    tables.delete_scans(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("id")), root)
    left = tables.read(spark, root, "scans").select("id", F.lit("scan").alias("kind"), "user_id")
    return left.unionByName(tables.read(spark, root, "chat_messages").select(F.concat_ws("/", "scan_id", "id").alias("id"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("user_id")))


@query
def stored_users(spark, d):
    """Users of a table on disk after logins of known and new ones; the second round of the same logins adds none."""
    root = _stored_tables(spark, d)
    logins = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    logins = logins.select((F.col("o_orderkey") + 1000000).alias("n"), F.lower("c_name").alias("email"), F.col("c_name").alias("name"))
    for _ in range(2):
        tables.insert_absent(logins.withColumn("id", F.col("n").cast("string")), root, "users", "n")
    return tables.read(spark, root, "users").select("id", "email", "name")


@query
def stored_metrics(spark, d):
    """Times of requests appended to a table on disk in two parts, as that table's report."""
    root = scratch.new_path(spark, "operational")
    tables.create(spark, root)
    rows = store.metric_rows(_requests(spark, d))
    for own in (F.col("endpoint") == "click", F.col("endpoint") != "click"):
        tables.append(rows.filter(own), root, "system_metrics")
    kept = tables.read(spark, root, "system_metrics")
    numbered = kept.groupBy("endpoint").agg(F.count_distinct("id").alias("n_ids"), F.count_if(F.col("created_at").isNull()).alias("n_without_time"))
    return store.latency(kept, between=False).join(numbered, "endpoint")


@query
def image_variants(spark, d):
    """Sizes and check sums of the twelve variants of small images on disk, one for each row of ``part``; a file holds up to a thousand."""
    root, (w, h) = scratch.new_path(spark, "images"), (24, 16)
    mark = F.sha2(F.concat_ws("/", "p_partkey", "p_name"), 256)
    body = F.repeat(F.translate(mark, "0123456789abcdef", "DEFGHIJKLMuvwxyz"), w * h // 64)  # all grey levels are printable characters
    head = F.concat(F.lit("P5\n# "), F.coalesce(F.col("p_partkey").cast("string"), F.lit("")), F.lit(f"\n{w} {h}\n255\n"))
    table(spark, d, "part").repartition("p_partkey").select(F.concat(head, body).alias("value")).write.option("maxRecordsPerFile", 1000).text(root)
    files = spark.read.format("binaryFile").load(root)
    images = pixels.unpacked(files).repartition(max(len(files.inputFiles()), 1))  # a task of variants for each file: they take far longer than reading
    return pixels.image_variants(images).select("image_id", "variant", "angle", "width", "height", F.crc32("pixels").alias("crc"))


@query
def replies_kept(spark, d):
    """Prompts about the documents' languages and sources, asked twice: how many replies are kept after a half and after all."""
    path = scratch.new_path(spark, "replies")
    asked = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("subject"))
    size = lambda: providers.kept_replies(spark, path).count()
    first = providers.ask_once(asked.filter("doc_id % 2 = 0"), providers.stub_analysis, "reply", ["subject"], path)
    kept = size()
    both = providers.ask_once(asked, providers.stub_analysis, "reply", ["subject"], path)
    same = both.join(first.select("doc_id", F.col("reply").alias("before")), "doc_id", "left")
    same = same.agg(F.count("*").alias("n"), F.count_if(F.col("before") == F.col("reply")).alias("n_same"), F.count_if(F.col("reply").isNull()).alias("n_without"))
    return same.withColumn("n_first", F.lit(kept).cast("bigint")).withColumn("n_both", F.lit(size()).cast("bigint"))


# Pipelines with stub models.


def _flat_analysis(rows: DataFrame, key: str) -> DataFrame:
    """The fields of an answer that the stubs fill, as columns."""
    names = F.array_join(F.transform("data.cheaper_alternatives", lambda a: F.concat_ws(": ", a["name"], a["price"])), "; ")
    texts = [F.col(f"data.{c}").alias(c) for c in ("brand_name", "generic_name", "ocr_text", "method", "price", "nppa_ceiling_price", "price_flag", "confidence")]
    return rows.select(key, "success", "error", *texts, F.array_join("data.uses", "; ").alias("uses"), names.alias("alternatives"))


@query
def pipeline_search(spark, d):
    asked = name_queries(spark, d).select("qid", F.col("query").alias("name"), F.lit("en-US").alias("target_language"))
    return _flat_analysis(pipelines.search(asked, *_catalogues(spark, d), providers.stub_analysis), "qid")


@query
def pipeline_analyze(spark, d):
    """Every part name that the stated query set asks for, as an image of its words."""
    asked = name_queries(spark, d).select(F.col("qid").cast("string").alias("image_id"), F.encode("query", "UTF-8").alias("content"))
    return _flat_analysis(pipelines.analyze(asked, providers.stub_words, *_catalogues(spark, d), providers.stub_analysis, providers.stub_analysis), "image_id")


@query
def pipeline_chat(spark, d):
    contexts = store.chat_context(scans(spark, d), messages(spark, d))
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    asked = table(spark, d, "conversations").withColumn("nth", F.row_number().over(last)).filter("nth = 1")
    asked = asked.select(F.col("conv_id").alias("request_id"), F.col("conv_id").cast("string").alias("scan_id"), F.col("text").alias("message"), F.lit("hi-IN").alias("target_language"))
    return pipelines.chat(asked, contexts, providers.stub_analysis, providers.stub_translation).withColumn("prompt", F.array_join("prompt", "\n"))
