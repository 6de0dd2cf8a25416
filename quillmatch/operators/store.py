"""Operational tables: appends, history pages, chat windows, upserts, deletes, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.functions.jsonx import stored_field, stored_field_anywhere, strict_json
from quillmatch.functions.text import last_items, leading_int, strip
from quillmatch.sources.catalogues import acceptable

ROLES = ("user", "assistant")  #: Fixed values: roles that a message may have.


# Appends: rows of a table from a request, with the table's defaults.


def scan_rows(results: DataFrame, image: bool) -> DataFrame:
    """Rows of ``scans`` from ``results(id, user_id, name, response_json[, data_json])``.

    An image's whole response is stored with the defaults of text, confidence and method; a text
    search stores the analysis, or the response where there is none, with confidence 1.
    """
    if image:
        fields = [F.col("name").alias("image_path"), F.col("response_json").alias("result_json"), F.lit("").alias("ocr_text"), F.lit(0.0).alias("ocr_confidence"), F.lit("ocr").alias("method")]
    else:
        fields = [
            F.lit("").alias("image_path"), F.coalesce("data_json", "response_json").alias("result_json"), strip(F.col("name")).alias("ocr_text"),
            F.lit(1.0).alias("ocr_confidence"), F.lit("text_search").alias("method"),
        ]
    return results.select("id", "user_id", *fields, now().alias("created_at"))


def message_rows(turns: DataFrame) -> DataFrame:
    """Rows of ``chat_messages`` from ``turns(scan_id, message, reply)``: the user's, and the reply's where there is one."""
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("message").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")))
    rows = turns.select("scan_id", F.inline(both)).filter((F.col("role") == "user") | F.col("content").isNotNull())
    return rows.withColumn("created_at", now())


def metric_rows(requests: DataFrame) -> DataFrame:
    """Rows of ``system_metrics`` from ``requests(endpoint, started, ended, succeeded)``; only successes count, as 200."""
    ok = requests.filter("succeeded")
    return ok.select("endpoint", elapsed_ms(F.col("started"), F.col("ended")).alias("response_time_ms"), F.lit(200).cast("bigint").alias("status_code"), now().alias("created_at"))


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def now() -> Column:
    """The present second, as a time without a zone."""
    return F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")


def upload_name(name: Column) -> Column:
    """A new name that keeps the extension."""
    return F.concat(F.expr("uuid()"), F.regexp_extract(name, r"(\.[^./]*)$", 1))


def uploads(files: DataFrame) -> DataFrame:
    """``upload_id, name, path, length`` of accepted ``files(path, length)``: each under a new name of its own, by which a scan stores it as its image."""
    named = acceptable(files).withColumn("name", upload_name(F.col("path")))
    return named.select(F.regexp_extract("name", r"^([^.]*)", 1).alias("upload_id"), "name", "path", "length")


# Answers to one request.


def scan_by_id(scans: DataFrame, scan_id: str) -> DataFrame:
    """The one scan of that id with all its columns, its stored result read strictly: bad JSON fails."""
    own = scans.filter(F.col("id") == scan_id).limit(1)
    return own.withColumn("result_json", strict_json(F.col("result_json")))


def response(results: DataFrame, image: bool) -> DataFrame:
    """What a request gets back: ``scan_id``, for an image its ``image_url``, and the fields of ``result``.

    ``results(id, image_path, result)``, ``result`` a struct.
    """
    url = [F.concat(F.lit("/uploads/"), F.col("image_path")).alias("image_url")] if image else []
    return results.select(F.col("id").alias("scan_id"), *url, "result.*")


def reply_of(reply: Column, response: Column) -> Column:
    """The reply of a chat model under either of its names."""
    return F.coalesce(F.nullif(reply, F.lit("")), response)


def shown_reply(response: Column, reply: Column, inner: Column, otherwise: str) -> Column:
    """What a chat shows: the first of the places that hold a reply, else ``otherwise``."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (response, reply, inner)], F.lit(otherwise))


# History.


def page_numbers(page: Column, limit: Column) -> tuple[Column, Column, Column]:
    """Page, limit and offset from request texts; both default where they begin with no number but zero."""
    p, n = leading_int(page, 1), leading_int(limit, 20)
    return p, n, (p - 1) * n


def history_entry(parity: bool = True) -> list[Column]:
    """Columns of a history list. Results wrapped in an envelope list as Unknown, unless ``parity`` is off."""
    field = stored_field if parity else stored_field_anywhere
    json = F.col("result_json")
    return [
        F.col("id"), F.concat(F.lit("/uploads/"), F.col("image_path")).alias("image_url"), field(json, "brand_name", "Unknown").alias("brand_name"),
        field(json, "generic_name", "").alias("generic_name"), F.col("ocr_confidence").alias("confidence"), "method", "created_at",
    ]


def history_page(scans: DataFrame, user: str | None, limit: int = 20, offset: int = 0, parity: bool = True) -> DataFrame:
    """One page of one user's scans, newest first, ties by id. No user is ``anonymous``, which no null owner equals.

    A negative limit is none, a negative offset zero.
    """
    own = scans.filter(F.col("user_id") == F.lit(user or "anonymous")).select(*history_entry(parity))
    own = own.orderBy(F.desc("created_at"), "id").offset(max(offset, 0))
    return own if limit < 0 else own.limit(limit)


def history_pages(scans: DataFrame, limit: int, page: int = 1, parity: bool = True) -> DataFrame:
    """The same page of every user at once, with ``user_id`` and ``rank``."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id"))
    ranked = scans.filter("user_id is not null").withColumn("rank", nth.cast("bigint")).filter(F.col("rank") <= page * limit)
    return ranked.filter(F.col("rank") > (page - 1) * limit).select("user_id", "rank", *history_entry(parity))


def pagination(scans: DataFrame, limit: int) -> DataFrame:
    """``user_id, total, pages`` of every user."""
    return scans.filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(float(limit))).cast("bigint"))


# Chats.


def message_window(messages: DataFrame, first: int | None = 20, last: int | None = 10) -> DataFrame:
    """The ``last`` of the ``first`` messages of each scan, oldest first, with ``pos`` from 1.

    In a longer chat that is never its newest part. ``messages(scan_id, id, role, content, created_at)``.
    """
    own = Window.partitionBy("scan_id")
    rows = messages.withColumn("pos", F.row_number().over(own.orderBy("created_at", "id")).cast("bigint"))
    if first is not None:
        rows = rows.filter(F.col("pos") <= first)
    if last is not None:
        size = messages.groupBy("scan_id").agg(F.count("*").alias("n"))
        if first is not None:
            size = size.withColumn("n", F.least("n", F.lit(first)))
        rows = rows.join(size, "scan_id").filter(F.col("pos") > F.col("n") - last).drop("n")
    return rows


def chat_context(scans: DataFrame, messages: DataFrame, first: int = 20) -> DataFrame:
    """``scan_id, context, history``: each scan's stored result with its first messages as an array (at most ``first``)."""
    rows = message_window(messages, first, None)
    item = F.struct("pos", F.struct("role", "content").alias("m"))
    history = rows.groupBy("scan_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["m"]).alias("history"))
    out = scans.select(F.col("id").alias("scan_id"), F.coalesce(F.nullif("result_json", F.lit("")), F.lit("{}")).alias("context")).join(history, "scan_id", "left")
    return out.withColumn("history", F.coalesce("history", F.array().cast(out.schema["history"].dataType)))


def chat_prompt(system: Column, history: Column, message: Column, last: int = 10) -> Column:
    """Prompt parts in order: the system text, the last messages as ``role: content``, the new message."""
    lines = F.transform(last_items(history, last), lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return F.concat(F.array(system), lines, F.array(F.concat(F.lit("user: "), message)))


# Changes.


def absent(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``new`` whose key is not null and not in ``table``; of equal keys the first by ``order``."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    once = new.filter(F.col(key).isNotNull()).withColumn("nth", nth).filter("nth = 1").drop("nth")
    return once.join(table.select(key), key, "left_anti")


def insert_absent(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` with the rows of ``new`` whose key it lacks; of equal new keys the first by ``order``."""
    return table.unionByName(absent(table, new, key, order).select(table.columns))


def cascade_delete(scans: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scans and messages without those of ``ids(id)``; unknown ids change nothing."""
    gone = ids.select("id").distinct()
    return scans.join(gone, "id", "left_anti"), messages.join(gone.select(F.col("id").alias("scan_id")), "scan_id", "left_anti")


# Checks that the tables' constraints name.


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    """``key, n`` of keys that are null or stand in more than one row."""
    return table.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose foreign key is not null and not in ``parent``."""
    return child.filter(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")


def bad_roles(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role").isNull() | ~F.col("role").isin(*ROLES))


def required(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows in which all columns hold more than white space, and the others."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (strip(F.coalesce(F.col(c), F.lit(""))) != "")
    return rows.filter(ok), rows.filter(~ok)


def latency(metrics: DataFrame, between: bool = True) -> DataFrame:
    """``endpoint, n, p50, p95, worst`` of the recorded times (an extension: nothing reports them otherwise).

    Quantiles are exact: interpolated between the two recorded times about them, or with ``between`` off the
    least recorded time that as large a share does not exceed. Null times count in ``n`` only. A rank is looked
    up among blocks of 65,536 ms and then within its block, so that no task orders all times of an endpoint
    (nor more than 65,536 rows of one, if its times are below 49 days).
    """
    times = metrics.groupBy("endpoint", F.col("response_time_ms").alias("ms")).agg(F.count("*").alias("k")).withColumn("block", F.shiftright("ms", 16))
    timed = times.filter(F.col("ms").isNotNull())
    whole = times.groupBy("endpoint").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("ms").isNotNull(), F.col("k"))), F.lit(0)).alias("n_timed"), F.max("ms").alias("worst"))
    ranks = []
    for name, percent in (("p50", 50), ("p95", 95)):
        place = (F.col("n_timed") - 1) * F.lit(percent / 100)
        disc = F.floor((F.col("n_timed") * percent + 99) / 100) - 1
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))) if between else (("lo", disc),):
            ranks.append(F.struct(F.lit(name).alias("q"), F.lit(end).alias("end"), rank.cast("long").alias("rank"), (place - F.floor(place)).alias("part")))
    asked = whole.filter("n_timed > 0").select("endpoint", F.inline(F.array(*ranks)))
    asked = _at_rank(timed.groupBy("endpoint", "block").agg(F.sum("k").alias("k")), asked, ["endpoint"], "block")
    found = _at_rank(timed, asked, ["endpoint", "block"], "ms")
    time = lambda q, end: F.max(F.when((F.col("q") == q) & (F.col("end") == end), F.col("ms")))
    part = lambda q: F.max(F.when(F.col("q") == q, F.col("part")))
    value = lambda q: time(q, "lo") * (1 - part(q)) + time(q, "hi") * part(q) if between else time(q, "lo")
    quantiles = found.groupBy(F.col("endpoint").alias("of")).agg(value("p50").alias("p50"), value("p95").alias("p95"))
    return whole.join(quantiles, F.col("endpoint").eqNullSafe(F.col("of")), "left").select("endpoint", "n", "p50", "p95", "worst")


def _at_rank(rows: DataFrame, asked: DataFrame, group: list[str], order: str) -> DataFrame:
    """``asked(*group, rank, ...)`` with the value of ``order`` at each rank (from 0) of its group, where ``rows`` stand for ``k`` each; ``rank`` is then the one among these."""
    upto = F.sum("k").over(Window.partitionBy(*group).orderBy(order))
    runs = rows.select(*(F.col(c).alias(f"of_{c}") for c in group), F.col(order), upto.alias("upto"), (upto - F.col("k")).alias("before"))
    met = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return asked.join(runs, met).select(*asked.drop("rank").columns, order, (F.col("rank") - F.col("before")).alias("rank"))
