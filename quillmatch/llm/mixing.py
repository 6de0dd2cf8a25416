"""Mixing sources to target weights by thresholds on a document hash; nothing is sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.llm.shared import WORD, as_row, written

WEIGHTS = (5.0, 2.0, 1.0)  #: Dealt to the sources in code-point order, over and over.
BITS = 12  #: Hash bits that one histogram level resolves.
LEVELS = 5  #: 5 x 12 bits of the 64-bit hash: below that, rows share one hash and are taken in proportion.


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``mx_size`` (words; null text: 0) and ``mx_hash`` (a hash of id and text)."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.withColumn("mx_size", words).withColumn("mx_hash", F.xxhash64(F.lit("mix"), F.col("doc_id"), F.xxhash64("text")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, source_size)``, one row a source.

    Targets are ``share`` of all sizes by weight; one that would pass ``most`` times its source's
    size stops there and its excess goes to the others by weight, until none is above. That is
    ``min(most * size, weight * level)`` with one level for all, which is found by raising the level
    over the sources that have not stopped; each round is one aggregate over the source table.
    """
    # A rank without one task for all sources: rows in order, ids by partition, plus the sizes of those before.
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("part", F.shiftright("at", 33)), "mix-sources")
    before = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = before.withColumn("skip", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ordered.join(F.broadcast(before.select("part", F.coalesce("skip", F.lit(0)).alias("skip"))), "part")
    nth = F.pmod(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("skip"), F.lit(len(weights))).cast("int")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0]
    level = -1.0
    while True:
        stopped = F.lit(most) * F.col("source_size") <= F.col("weight") * F.lit(level)
        at_cap, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(stopped, F.lit(most) * F.col("source_size"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0)),
        ).first()
        new = (share * total - at_cap) / open_weight if open_weight else level
        if new <= level or not open_weight:
            break
        level = new
    target = F.least(F.lit(most) * F.col("source_size"), F.col("weight") * F.lit(max(level, 0.0)))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Where each source's extra budget ends: ``source, ..., whole, t1..tN, rest, rest_size``.

    A source takes every document ``whole = floor(target / size)`` times, and once more those whose
    hash lies before the threshold. The threshold is found by nested histograms: words by source and
    the first ``BITS`` of the hash give the bucket in which the budget ends, only that bucket is
    dealt into the next level's buckets, and so on; ``t1..tN`` are the boundary buckets. The rows of
    the last one (one document, or rows with the same hash) share the ``rest`` of the budget.
    Budgets count in words, so the histograms are exact.
    """
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    state = goals.withColumn("rest", F.round(F.col("target")).cast("bigint") - F.col("whole") * F.col("source_size")).withColumn("rest", F.greatest("rest", F.lit(0)))
    for level in range(1, LEVELS + 1):
        inside = rows.join(state.select(F.col("source").alias("g_source"), *[f"t{i}" for i in range(1, level)]), F.col("source").eqNullSafe(F.col("g_source")))
        for i in range(1, level):
            inside = inside.filter(_digit(i) == F.col(f"t{i}"))
        sums = inside.groupBy("source", _digit(level).alias("digit")).agg(F.sum("mx_size").alias("words"))
        run = Window.partitionBy("source").orderBy("digit")
        sums = sums.withColumn("upto", F.sum("words").over(run))
        ends = sums.join(state.select(F.col("source").alias("g_source"), "rest"), F.col("source").eqNullSafe(F.col("g_source")))
        ends = ends.filter("upto >= rest").groupBy("source").agg(F.min(F.struct("digit", F.col("upto") - F.col("words"), "words")).alias("b"))
        ends = ends.select(F.col("source").alias("b_source"), F.col("b.digit").alias(f"t{level}"), F.col("b.col2").alias("used"), F.col("b.words").alias("last_words"))
        state = state.drop("last_words").join(ends, F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source")
        state = written(state.withColumn("rest", F.col("rest") - F.coalesce("used", F.lit(0))).drop("used"), f"mix-level{level}")
    return state


def _digit(level: int):
    """The ``level``-th group of hash bits, from the top."""
    return F.shiftrightunsigned("mx_hash", 64 - BITS * level).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def taken_words(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``taken``, by comparing hashes with the thresholds."""
    keep = state.select(F.col("source").alias("g_source"), "source_size", "target", "whole", "rest", "last_words", *[f"t{i}" for i in range(1, LEVELS + 1)])
    joined = rows.join(keep, F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_source")
    before, same = F.lit(False), F.lit(True)
    for i in range(1, LEVELS + 1):
        before = before | (same & (_digit(i) < F.col(f"t{i}")))
        same = same & (_digit(i) == F.col(f"t{i}"))
    part = F.when(F.col("last_words") > 0, F.floor(F.col("mx_size") * F.col("rest") / F.col("last_words"))).otherwise(0)
    extra = F.when(before, F.col("mx_size")).when(same, part).otherwise(0)
    taken = F.col("whole") * F.col("mx_size") + F.coalesce(extra, F.lit(0))
    return joined.withColumn("taken", taken.cast("bigint")).drop("whole", "rest", "last_words", *[f"t{i}" for i in range(1, LEVELS + 1)])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)``: ``doc_id, size, source_size, target, taken``.

    ``size`` counts the words of the whole text (null: 0). ``taken`` is what the mix takes of the
    document, repeats counted: never over ``most`` times its size, and per source within rounding of
    the target, as the document on the threshold is taken in part. The null source is a source (last
    in order); rows that repeat id and text share one hash and are taken alike; an empty table gives
    an empty result; sources without a word have target 0. Reruns agree: only hashes decide.
    """
    rows = written(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "mx_size", "mx_hash"), "mix-sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("mx_size").alias("source_size")), weights, share, most)
    out = taken_words(rows, thresholds(rows, goals))
    return out.select("doc_id", F.col("mx_size").alias("size"), "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as it is taken (0, 1 or 2 times).

    A document on the threshold counts as taken once more if at least half of it is. Documents
    without a word (null and empty texts among them) have no share in any target and stay out; the null
    source is a source; rows that repeat id and text are taken alike; columns of any other name pass
    through; an empty table gives an empty result.
    """
    narrow = written(sized(docs.select("doc_id", "source", "text")).select("source", "mx_size", "mx_hash"), "mix-sizes")
    goals = targets(narrow.groupBy("source").agg(F.sum("mx_size").alias("source_size")), weights, share, most)
    rows = sized(docs.select(as_row(docs), "doc_id", "source", "text")).select("row", "source", "mx_size", "mx_hash")
    out = taken_words(rows, thresholds(narrow, goals))
    times = F.when(F.col("mx_size") > 0, F.floor(F.col("taken") / F.col("mx_size") + 0.5)).otherwise(0).cast("int")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).select("row.*")
