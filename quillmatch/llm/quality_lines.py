"""Quality rules: base rules on a text, and cross-document line frequency per host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.shared import as_row, in_tasks, row_key, same_key, with_texts, written

LEAST_DOCS = 10  #: A line in no more distinct documents of its host than this is never frequent.
MOST_SHARE = 0.1  #: Beyond that, one in more than this share of the host's documents is,
MOST_DOCS = 1000  #: and one in more documents than this, whatever the size of the host.
DEPLETED = 0.5  #: A document is rejected when frequent lines hold more than this share of its words.

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Normalised lines: A-Z lower-cased, digits alike.
FOLD = bytes(ord("0") if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def repeat_words(words: list, window: int = 5) -> int:
    """Words that lie in a ``window``-word window which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words)) + np.uint64(1)
    x ^= x * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[4]
    x ^= x >> np.uint64(32)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ (key >> np.uint64(31))) * _MIX[k % 5] + x[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def line_key(line: str) -> tuple[int, int]:
    """Signed hash of the normalised line, and its words; (0, 0) for a line without one."""
    words = line.encode().translate(FOLD).split()
    return (xxhash.xxh64_intdigest(b" ".join(words), 7) - (1 << 63), len(words)) if words else (0, 0)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the base measures, and of each distinct normalised line its hash and words."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                text = text or ""
                words = text.encode().split()
                seen: set[str] = set()
                dup = 0
                lines: dict[int, int] = {}
                for line in text.split("\n"):
                    key, n = line_key(line)
                    if n:
                        lines[key] = lines.get(key, 0) + n
                        if line in seen:
                            dup += 1
                        seen.add(line)
                row = (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words), list(lines), list(lines.values()))
                for col, v in zip(cols, row):
                    col.append(v)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    out = f"{schema}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_hash array<bigint>, line_words array<bigint>"
    return in_tasks(docs, run, out, text=docs.columns.index("text"))


def text_key() -> list:
    """A 128-bit hash of the text alone: rows of equal text are one document of their host."""
    body = F.col("text")
    return [F.xxhash64(F.lit("a"), body.isNull(), body).alias("t_a"), F.xxhash64(F.lit("b"), body, F.length(body)).alias("t_b")]


def frequent_lines(facts: DataFrame, least_docs: int = LEAST_DOCS, most_share: float = MOST_SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """``host, line``: the lines in more than ``least_docs`` of the host's distinct documents and in more than ``most_share`` or ``most_docs`` of them."""
    own = facts.select(F.col("source").alias("host"), "t_a", "t_b", F.explode("line_hash").alias("line")).distinct()
    counts = own.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > least_docs)
    hosts = facts.select(F.col("source").alias("h"), "t_a", "t_b").distinct().groupBy("h").agg(F.count("*").alias("n_docs"))
    many = F.least(most_share * F.col("n_docs"), F.lit(float(most_docs)))
    return counts.join(hosts, counts["host"].eqNullSafe(hosts["h"])).filter(F.col("n") > many).select("host", "line")


def judged(docs: DataFrame, least_docs: int = LEAST_DOCS, most_share: float = MOST_SHARE, depleted: float = DEPLETED, most_docs: int = MOST_DOCS) -> DataFrame:
    """A row for each row of ``docs(doc_id, source, text)``: row key, measures, ``n_frequent_words``, ``frequent`` lines, verdict."""
    facts = written(measured(docs.select("doc_id", "source", "text", *row_key(), *text_key())).withColumn("row_id", F.monotonically_increasing_id()), "quality-facts")
    frequent = written(frequent_lines(facts, least_docs, most_share, most_docs), "quality-frequent")
    lines = facts.select("row_id", "source", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l"))
    hits = lines.join(frequent, (F.col("l.line_hash") == frequent["line"]) & lines["source"].eqNullSafe(frequent["host"]))
    removed = hits.groupBy("row_id").agg(F.sum("l.line_words").alias("n_frequent_words"), F.collect_set("line").alias("frequent"))
    out = facts.drop("line_hash", "line_words").join(removed, "row_id", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    gone = F.coalesce("n_frequent_words", F.lit(0))
    out = out.withColumn("n_frequent_words", gone.cast("bigint")).withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (F.col("n_frequent_words") <= depleted * F.col("n_words")))


def quality(docs: DataFrame, least_docs: int = LEAST_DOCS, most_share: float = MOST_SHARE, depleted: float = DEPLETED, most_docs: int = MOST_DOCS) -> DataFrame:
    """One row per row of ``docs``: measures, ``base_failed``, ``kept``, and the words on frequent lines.

    Lines are compared with A-Z lower-cased, digits alike and white space as one space. A line is
    frequent when more than ``least_docs`` of the documents of its host (``source``; null is a host)
    hold it and also more than ``most_share`` of them or more than ``most_docs``, where rows of equal text are one document, so copies are no
    evidence against their lines. Null, empty and white-space texts have no words and fail; repeated
    rows each get a row; further columns are ignored; an empty table gives an empty result.
    """
    return judged(docs, least_docs, most_share, depleted, most_docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words"
    )


def passed(docs: DataFrame, least_docs: int = LEAST_DOCS, most_share: float = MOST_SHARE, depleted: float = DEPLETED, most_docs: int = MOST_DOCS) -> DataFrame:
    """``docs`` without the rejected documents, and with the frequent lines of the others removed (``n_chars`` follows).

    Null, empty and white-space texts fail and go; repeated rows stay as often as they come, and lose
    the same lines; null hosts are one host; columns of any other name pass through; an empty table
    gives an empty result.
    """
    found = judged(docs, least_docs, most_share, depleted, most_docs).filter("not kept or frequent is not null")
    verdict = found.groupBy("rk_a", "rk_b", F.xxhash64(F.col("source").isNull(), "source").alias("at")).agg(F.first("kept").alias("kept"), F.first("frequent").alias("frequent"))
    whole = docs.select(as_row(docs), *row_key(), F.xxhash64(F.col("source").isNull(), "source").alias("at"))
    out = whole.join(verdict, same_key(whole, verdict) & (whole["at"] == verdict["at"]), "left").filter("kept is null or kept")
    out = out.select("row", "frequent")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(at).to_pylist()
            for i, lines in enumerate(batch.column(1).to_pylist()):
                if lines:
                    bad = set(lines)
                    texts[i] = "\n".join(x for x in texts[i].split("\n") if line_key(x)[0] not in bad)
            yield pa.RecordBatch.from_arrays(with_texts(batch.column(0), names, texts), names=names)

    return in_tasks(out, run, docs.schema, text=0)


#: The same in DuckDB.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
win AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
ln AS (SELECT r, source, t, l, list_aggregate(list_transform(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')), 'string_agg', ' ') AS n,
              len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS words
       FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS n_docs FROM d GROUP BY source),
freq AS (SELECT ln.source, ln.n FROM ln JOIN hosts h ON ln.source IS NOT DISTINCT FROM h.source GROUP BY ln.source, ln.n, h.n_docs
         HAVING count(DISTINCT ln.t) > {LEAST_DOCS} AND count(DISTINCT ln.t) > least(CAST({MOST_SHARE} AS DOUBLE) * h.n_docs, CAST({MOST_DOCS} AS DOUBLE))),
hit AS (SELECT r, sum(words) AS n FROM ln JOIN freq f ON ln.source IS NOT DISTINCT FROM f.source AND ln.n = f.n GROUP BY r),
m AS (SELECT d.r, doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_frequent_words
      FROM d JOIN w ON d.r = w.r LEFT JOIN dup ON d.r = dup.r LEFT JOIN rep ON d.r = rep.r LEFT JOIN hit ON d.r = hit.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_frequent_words <= CAST({DEPLETED} AS DOUBLE) * n_words AS kept, n_frequent_words
FROM m
"""
