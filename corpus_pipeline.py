"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, mixing and packing.

All stages but the last return the columns of their input, whatever their names; an empty table gives an
empty result in each. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm.line_edit_join import deduped
from quillmatch.llm.mixing import mixed_documents
from quillmatch.llm.packing import pack
from quillmatch.llm.quality_lines import passed
from quillmatch.llm.shared import discard, written
from quillmatch.llm.shingle_copies import keep_first_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines too frequent for their host go from the rest.

    Null and empty texts fail and go; a null source is a host; rows that repeat id and text fare alike and
    stay as often as they come; equal texts count as one document of their host; columns of clashing names
    pass through; an empty table gives an empty result.
    """
    return passed(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line exactly or within two edits go, and documents of which no word is left.

    Null and empty texts have no lines and stay; the order is by ``doc_id`` (null last), ties by a hash of id
    and text; rows that repeat both lose the same lines; columns of clashing names pass through; an empty
    table gives an empty result.
    """
    return deduped(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: a Jaccard similarity of 0.8 or more on shingles of five words.

    Texts without a word (null and empty ones) are alike; the smallest ``doc_id`` stays (null last, ties by a
    hash of id and text); of rows that repeat both the first by their other columns stays; columns of
    clashing names pass through; an empty table gives an empty result.
    """
    return keep_first_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice.

    Null and empty texts have no words and stay out; a null source is a source; rows that repeat id and text
    are taken alike; columns of clashing names pass through; an empty table gives an empty result.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences.

    A null text is an empty one (one token); long texts are cut into whole sequences and a rest; every row,
    repeated or with a null id, is packed for itself; other columns are left behind; an empty table gives an
    empty result.
    """
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages hash, match and pack in ways SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)  # nothing reads it any more
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
