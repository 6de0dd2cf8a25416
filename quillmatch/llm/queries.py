"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm import chat_collapse, digest_index, prefix_trie, quality_lines, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmatch.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmatch.llm.simhash_vptree import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmatch.llm.embedding_lsh import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmatch.llm.html_paths import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.formatted(_table(spark, sf_dir, "conversations"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmatch.llm.line_edit_join import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents"), per_edit=0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.quality(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmatch.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmatch.llm.toxicity_gru import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmatch.llm.langid_mixture import languages

    return languages(_table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_chat": op2_chat,
    "op3_mixing": op3_mixing,
    "op4_lines": op4_lines,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_langid": op8_langid,
    "op9_simhash": op9_simhash,
    "op10_embedding": op10_embedding,
    "op11_codes": op11_codes,
    "op12_trie": op12_trie,
    "op13_dedup": op13_dedup,
}

ORACLE: dict[str, str] = {"op2_chat": chat_collapse.ORACLE_SQL, "op5_quality": quality_lines.ORACLE_SQL, "op11_codes": vector_codes.ORACLE_SQL, "op12_trie": prefix_trie.ORACLE_SQL, "op13_dedup": digest_index.ORACLE_SQL}
