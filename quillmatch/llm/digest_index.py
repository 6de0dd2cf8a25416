"""Exact dedup against a persistent index of digests, in DataFrame and SQL operations only.

The index is a table of its own: one entry for each different text seen so far, bucketed and sorted by
digest, a partition for each delivery. New data is reduced to one row a digest, meets the index in a
sort-merge anti-join that reads the index without an exchange, and what is new is appended. Only ids and
digests are shuffled, no texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.grouping import hot_from, meet
from quillmatch.llm.shared import written
from quillmatch.sources.scratch import make_folder, new_path, remove

BUCKETS = 64  #: Buckets of an index: a task of the anti-join reads one. To be set by the size that the index is to reach.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digested(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` of ``docs(doc_id, text)``: SHA-256 of the text with A-Z lower-cased; a null text is an empty one."""
    body = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.unhex(F.sha2(body, 256)).alias("digest"))


class DigestIndex:
    """Digests seen so far, under ``path``: ``digest, keep_id, mark``, partitioned by ``delivery``.

    ``path`` is a folder that driver and executors share; the files there are the index, so another
    session opens it by the same path and number of buckets. A delivery is one ingested table; ingesting
    a delivery again (after a failure, say) first takes back what it had appended.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.name = spark, path, buckets, f"digest_index_{uuid.uuid4().hex}"
        make_folder(spark, path)
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, mark BIGINT, delivery STRING) USING parquet PARTITIONED BY (delivery) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")  # of an index that was there before

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, rows: DataFrame, delivery: str) -> None:
        """Appends the digests of ``rows(doc_id, digest, mark)`` that no other delivery has, each with its largest ``doc_id`` (null is the least).

        ``mark`` tells rows of one id and digest apart: of those the largest mark is kept. ``rows`` is pre-aggregated
        before its shuffle, so a text that a third of the rows hold costs a row a task.
        """
        self.take_back(delivery)
        best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "mark")).alias("best"))
        fresh = best.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        fresh.select("digest", "best.doc_id", "best.mark", F.lit(delivery)).write.insertInto(self.name)

    def take_back(self, delivery: str) -> None:
        """Removes what a delivery appended."""
        if self.entries().filter(F.col("delivery") == delivery).limit(1).count():
            self.spark.sql(f"ALTER TABLE {self.name} DROP PARTITION (delivery = '{delivery}')")
            remove(self.spark, f"{self.path}/delivery={delivery}")

    def compact(self, into: str) -> "DigestIndex":
        """The same entries as an index in the new folder ``into`` with one delivery, ``all``: one sorted file a bucket, however many deliveries came."""
        out = DigestIndex(self.spark, into, self.buckets)
        rows = self.entries().repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.select("digest", "keep_id", "mark", F.lit("all")).write.insertInto(out.name)
        return out

    def close(self) -> None:
        """Forgets the table's name in this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after lower-casing A-Z only; null is the empty text, and texts are
    hashed whole. Of equal texts the row with the largest ``doc_id`` stays, a null id being the least;
    of rows that repeat id and text one stays. Further columns are ignored; an empty table gives an
    empty result. The rows come to the index in two deliveries, the upper half of the ids before the
    lower, so that the larger id is always the one that is there first.
    """
    spark = docs.sparkSession
    rows = written(digested(docs).withColumn("mark", F.monotonically_increasing_id()), "dedup-rows")
    index = DigestIndex(spark, new_path(spark, "dedup-index"), buckets)
    facts = rows.agg(F.count("*").alias("n"), F.floor((F.min("doc_id") / 2 + F.max("doc_id") / 2)).alias("middle")).first()
    upper = F.coalesce(F.col("doc_id") > F.lit(facts["middle"]), F.lit(False))
    index.ingest(rows.filter(upper), "upper")
    index.ingest(rows.filter(~upper), "lower")
    sizes = rows.groupBy("digest").agg(F.count("*").alias("n"))
    groups = sizes.join(index.entries().drop("delivery").hint("merge"), "digest").withColumn("group_size", F.col("n"))
    groups = written(groups.withColumnRenamed("mark", "keep_mark"), "dedup-groups")
    index.close()
    remove(spark, index.path)
    out = meet(rows, groups, "digest", hot_from(facts["n"]))
    return out.select("doc_id", "keep_id", "group_size", (F.col("mark") == F.col("keep_mark")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: The same in DuckDB.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM d
"""
