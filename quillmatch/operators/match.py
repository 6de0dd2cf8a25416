"""Fuzzy matching of names: character n-gram TF-IDF with exact cosine top-k, as an inverted index of DataFrames.

One index holds any number of catalogues, stacked: all its tables are keyed by ``cat`` first, so one
search answers for several of them. Equal normalised texts are indexed once with their multiplicity, so a
catalogue of few names and many rows costs what its names cost; document frequencies and the corpus size
still count every row. Whole documents are searched by ``block_search``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.functions.text import grams, normalise, round3
from quillmatch.sources.scratch import new_path, stored

THRESHOLD = 0.1  #: Scores have to exceed this, before any rounding.
RANK_DIGITS = 1e6  #: Ranks compare scores rounded to six decimals; ties go to the smaller id.
BUCKETS = 16  #: Buckets of a saved index by n-gram.


@dataclass
class MatchIndex:
    """``postings(cat, text_id, gram, w)`` with unit-length weights, ``idf(cat, gram, idf)``, ``texts(cat, text_id, ids)``.

    ``text_id`` is the smallest id of a distinct text and ``ids`` its ``keep`` smallest. A fitted index is a
    plan: ``hold`` persists it for several searches and ``release`` ends that; ``save`` and ``load`` keep it
    for other sessions, with postings bucketed by n-gram, so that a search reads them without an exchange.
    """

    postings: DataFrame
    idf: DataFrame
    texts: DataFrame
    keep: int

    def hold(self) -> "MatchIndex":
        for df in (self.postings, self.idf, self.texts):
            df.persist()
        return self

    def release(self) -> None:
        for df in (self.postings, self.idf, self.texts):
            df.unpersist()

    def save(self, path: str, buckets: int = BUCKETS) -> None:
        """Writes the index under ``path``, in place of one that is there; postings lie in ``buckets`` sorted buckets by catalogue and n-gram."""
        spark, name = self.postings.sparkSession, _table_name(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        dealt = self.postings.repartition(buckets, "cat", "gram")
        dealt.write.mode("overwrite").bucketBy(buckets, "cat", "gram").sortBy("cat", "gram").option("path", f"{path}/postings").saveAsTable(name)
        self.idf.write.mode("overwrite").parquet(f"{path}/idf")
        self.texts.write.mode("overwrite").parquet(f"{path}/texts")
        spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(self.keep).alias("keep")).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "MatchIndex":
        """An index that ``save`` wrote, in this or another session."""
        about, name = spark.read.schema("buckets int, keep int").json(f"{path}/about").first(), _table_name(path)
        postings = spark.read.parquet(f"{path}/postings")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in postings.schema)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cat, gram) SORTED BY (cat, gram) INTO {about['buckets']} BUCKETS LOCATION '{path}/postings'")
        return cls(spark.table(name), spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/texts"), about["keep"])


def _table_name(path: str) -> str:
    """The name by which a session knows the bucketed postings under a path."""
    return "match_postings_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def term_counts(texts: DataFrame, *keys: str) -> DataFrame:
    """``*keys, gram, tf`` of ``texts(*keys, n)``. All n-grams of a text lie in its own row's partition, so counting them moves no data."""
    return texts.repartition(*keys).select(*keys, F.explode(grams(F.col("n"))).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").cast("double").alias("tf"))


def fit(corpus: DataFrame, doc_id: str, text: str, keep: int = 5) -> MatchIndex:
    """An index of one catalogue, named ''. ``keep`` is the largest k it can answer."""
    return fit_stacked({"": (corpus, doc_id, text)}, keep)


Corpora = dict[str, tuple[DataFrame, str, str]]  #: Catalogue -> its rows, their id column and their text column.


def corpus_rows(corpora: Corpora) -> DataFrame:
    """``cat, doc_id, n`` of all catalogues: ``n`` is the normalised text."""
    parts = [df.select(F.lit(name).alias("cat"), F.col(i).alias("doc_id"), normalise(F.coalesce(F.col(t), F.lit(""))).alias("n")) for name, (df, i, t) in corpora.items()]
    return reduce(DataFrame.unionByName, parts)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``cat, n, m, text_id``: each distinct text, how often it comes and its smallest id."""
    return rows.groupBy("cat", "n").agg(F.count("*").alias("m"), F.min("doc_id").alias("text_id"))


def least_ids(rows: DataFrame, keep: int) -> DataFrame:
    """``cat, text_id, ids``: the ``keep`` smallest ids of each distinct text."""
    nth = F.row_number().over(Window.partitionBy("cat", "n").orderBy("doc_id"))
    ids = rows.withColumn("nth", nth).filter(F.col("nth") <= keep).groupBy("cat", "n").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return ids.select("cat", F.element_at("ids", 1).alias("text_id"), "ids")


def frequencies(tf: DataFrame, rows: DataFrame) -> DataFrame:
    """``cat, gram, idf`` from ``tf(cat, m, gram)``, a row for each distinct text and n-gram, and the rows of the corpora."""
    totals = rows.groupBy("cat").agg(F.count("*").alias("n_docs"))  # a row a catalogue
    df = tf.groupBy("cat", "gram").agg(F.sum("m").alias("df"))
    return df.join(F.broadcast(totals), "cat").select("cat", "gram", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weights(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """``cat, text_id, gram, w`` of unit length a text."""
    # At most 37**2 + 37**3 + 37**4 n-grams a catalogue exist over a-z, 0-9 and space: small enough to send to every task.
    weighted = tf.join(F.broadcast(idf), ["cat", "gram"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("cat", "text_id", "m")))
    return weighted.select("cat", "text_id", "gram", (F.col("w") / norm).alias("w"))


def fit_stacked(corpora: Corpora, keep: int = 5) -> MatchIndex:
    """One index of several catalogues, as one plan; each catalogue has frequencies of its own."""
    rows = corpus_rows(corpora)
    tf = term_counts(distinct_texts(rows), "cat", "text_id", "m")
    idf = frequencies(tf, rows)
    return MatchIndex(weights(tf, idf), idf, least_ids(rows, keep), keep)


def fit_stored(corpora: Corpora, path: str | None = None, keep: int = 5, buckets: int = BUCKETS) -> MatchIndex:
    """The same index, computed step by step and saved under ``path`` (without one, in the shared folder until the application ends).

    No step is computed twice, and plans of searches start at the stored tables.
    """
    rows = corpus_rows(corpora)
    path = path or new_path(rows.sparkSession, "match-index")
    tf = stored(term_counts(distinct_texts(rows), "cat", "text_id", "m"), "match-counts")
    idf = stored(frequencies(tf, rows), "match-idf")
    MatchIndex(weights(tf, idf), idf, least_ids(rows, keep), keep).save(path, buckets)
    return MatchIndex.load(rows.sparkSession, path)


def scores(index: MatchIndex, queries: DataFrame) -> DataFrame:
    """``cat, n, text_id, raw``: cosines above the threshold between distinct queries ``(cat, n)`` and indexed texts."""
    # Queries are distinct, so an exchange for them is not needed: each is counted where it lies.
    tf = queries.select("cat", "n", F.explode(grams(F.col("n"))).alias("gram")).groupBy("cat", "n", "gram").agg(F.count("*").cast("double").alias("tf"))
    tf = tf.join(F.broadcast(index.idf), ["cat", "gram"]).withColumn("wq", F.col("tf") * F.col("idf"))  # unknown n-grams leave the query before its norm
    norm = F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(Window.partitionBy("cat", "n")))
    unit = tf.select("cat", "n", "gram", (F.col("wq") / norm).alias("wq"))
    dots = unit.join(index.postings, ["cat", "gram"]).groupBy("cat", "n", "text_id").agg(F.sum(F.col("wq") * F.col("w")).alias("raw"))
    return dots.filter(F.col("raw") > THRESHOLD)


def top_k(index: MatchIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """``qid, doc_id, rank, match_score``: the ``k`` best rows for each of ``queries(qid, query)``, in the catalogue ``cat`` where queries have that column (it is returned then).

    A text among the best k has fewer than k texts before it, so k texts are kept first, each with its
    k smallest ids, and the rows are ranked after that.
    """
    if k > index.keep:
        raise ValueError(f"the index keeps {index.keep} ids a text; k is {k}")
    named = ["cat"] if "cat" in queries.columns else []
    asked = queries.select("qid", (F.col("cat") if named else F.lit("")).alias("cat"), normalise(F.coalesce("query", F.lit(""))).alias("n"))
    found = scores(index, asked.select("cat", "n").distinct())
    ranked = best_rows(found, index.texts, k)
    return asked.join(ranked, ["cat", "n"]).select(*named, "qid", "doc_id", "rank", round3(F.col("raw")).alias("match_score"))


def best_rows(found: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``cat, n, raw, doc_id, rank``: the ``k`` best rows for each query of ``found(cat, n, text_id, raw)``."""
    found = found.withColumn("key", F.rint(F.col("raw") * RANK_DIGITS) / RANK_DIGITS)
    nth = F.row_number().over(Window.partitionBy("cat", "n").orderBy(F.desc("key"), "text_id"))
    best = found.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")
    rows = best.join(texts, ["cat", "text_id"]).select("cat", "n", "raw", "key", F.explode(F.slice("ids", 1, k)).alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("cat", "n").orderBy(F.desc("key"), "doc_id"))
    return rows.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)
