"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Chat logs often store a conversation again after every turn. A rolling hash of the turns so far names
every prefix of every conversation; a conversation whose whole hash is a proper prefix of another is
a snapshot and goes; equal conversations leave one. The rest is rendered.

The rolling hash is the XOR of one 128-bit hash per (position, role, text), so it is a sum that can be
built over blocks of turns: no step needs all turns of a conversation in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.llm.shared import written

TURNS = 1000  #: Turn numbers to a block of one conversation.
BLOCK = ["conv", "block"]


def placed(turns: DataFrame) -> DataFrame:
    """``conv, block, part, n_turns, pos, role, text`` with ``pos`` from 0 in the order of turn (nulls first, by a hash), role and text.

    Rows that repeat in all four columns count once. A block holds ``TURNS`` turn numbers, or one of
    4,096 hash ranges of the rows without one; ``part`` numbers the blocks of a conversation. ``conv``
    is the id in a struct, as which null ids meet each other in joins.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct().withColumn("conv", F.struct("conv_id"))
    lost = F.when(F.col("turn").isNull(), F.xxhash64(F.lit("turn"), F.col("role").isNull(), "role", F.col("text").isNull(), "text"))
    rows = rows.withColumn("lost", lost).withColumn("block", F.coalesce(F.floor(F.col("turn") / F.lit(TURNS)), F.shiftright("lost", 52) - F.lit(1 << 62)))
    conversation = Window.partitionBy("conv")
    before = conversation.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*BLOCK).agg(F.count("*").alias("n"))
    sizes = sizes.select(
        *BLOCK, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(conversation).alias("n_turns"),
        (F.row_number().over(conversation.orderBy("block")) - 1).cast("bigint").alias("part"),
    )
    order = Window.partitionBy(*BLOCK).orderBy("lost", "turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("nth", F.row_number().over(order)).join(sizes, BLOCK)
    return rows.select(*BLOCK, "part", "n_turns", (F.col("nth") - 1 + F.col("skip")).cast("bigint").alias("pos"), "role", "text")


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``h1, h2``: the hash of the conversation's turns up to and with this one."""
    parts = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    marks = rows.withColumn("m1", F.xxhash64(F.lit(1), *parts)).withColumn("m2", F.xxhash64(F.lit(2), *reversed(parts)))
    within = Window.partitionBy(*BLOCK).orderBy("pos")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = marks.groupBy(*BLOCK).agg(F.bit_xor("m1").alias("b1"), F.bit_xor("m2").alias("b2"))
    sums = sums.select(*BLOCK, F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("p1"), F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("p2"))
    marks = marks.withColumn("r1", F.bit_xor("m1").over(within)).withColumn("r2", F.bit_xor("m2").over(within)).join(sums, BLOCK)
    return marks.select(*rows.columns, F.col("r1").bitwiseXOR(F.col("p1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("p2")).alias("h2"))


def maximal(hashed: DataFrame) -> DataFrame:
    """``conv, n_copies`` of the conversations that no other one continues, one of each set of equal ones.

    Of equal conversations the smallest ``conv_id`` stays. Prefixes and wholes are made distinct
    before they meet, so many copies of one conversation or of one first turn are one row each.
    """
    upto = hashed.select("conv", (F.col("pos") + 1).alias("n"), "h1", "h2", (F.col("pos") + 1 == F.col("n_turns")).alias("whole"))
    heads = upto.filter("whole").groupBy("n", "h1", "h2").agg(F.struct(F.min("conv.conv_id").alias("conv_id")).alias("conv"), F.count("*").alias("n_copies"))
    inner = upto.filter("not whole").select("n", "h1", "h2").distinct()
    return heads.join(inner, ["n", "h1", "h2"], "left_anti").select("conv", "n_copies")


def render(role, text):
    """One turn in the chat template."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def formatted(turns: DataFrame) -> DataFrame:
    """Maximal conversations of ``turns(conv_id, turn, role, text)``, rendered: ``conv_id, part, n_turns, n_copies, text``.

    ``part`` numbers the stretches of ``TURNS`` turn numbers from 0 in order (one for all but very long logs);
    their texts put together are the conversation, so no row gathers an unbounded number of turns.
    A null role renders as user, a null text as empty; null turns come first, in the order of a hash;
    rows with a null ``conv_id`` form one conversation; repeated rows count once; further columns are ignored; an empty table gives an empty result. ``n_copies`` counts the equal
    conversations that the row stands for (itself included).
    """
    hashed = written(prefixes(placed(turns)), "chat-prefixes")
    kept = hashed.join(maximal(hashed), "conv").select(*BLOCK, "part", "n_turns", "n_copies", "pos", "role", "text")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", render(F.col("role"), F.col("text")).alias("line")))), lambda x: x["line"]), "")
    return kept.groupBy("conv.conv_id", "part", "n_turns", "n_copies").agg(lines.alias("text"))


#: The same in DuckDB, by comparing the turns themselves.
ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, to_json(list({'r': role, 't': text} ORDER BY pos)) AS body,
             string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
      FROM p GROUP BY conv_id),
prefix AS (SELECT DISTINCT md5(to_json(list({'r': a.role, 't': a.text} ORDER BY a.pos))) AS h
           FROM p a JOIN p b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.pos <= b.pos
           JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.pos < c.n_turns
           GROUP BY b.conv_id, b.pos),
heads AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, body, text FROM c GROUP BY n_turns, body, text)
SELECT conv_id, CAST(0 AS BIGINT) AS part, n_turns, n_copies, text FROM heads WHERE md5(body) NOT IN (SELECT h FROM prefix)
"""
