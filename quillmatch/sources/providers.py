"""External models behind one small interface, called in batches of rows on the executors.

A provider is a factory, called once per task, that returns a function from a pandas frame of requests
to the replies. The stubs answer deterministically, so plans can be tested without a network.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.sources.scratch import make_folder, stored

Answer = Callable[[pd.DataFrame], list]


def ask(requests: DataFrame, provider: Callable[[], Answer], reply: str, kind: str = "string", on_error: Callable[[Exception], str] | None = None) -> DataFrame:
    """``requests`` with a ``reply`` column from the provider; a batch that fails gives ``on_error`` for each of its rows."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema)}, `{reply}` {kind}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = provider()
        for frame in frames:
            try:
                replies = answer(frame)
            except Exception as e:  # the provider's own failure is an answer, not the job's
                if on_error is None:
                    raise
                replies = [on_error(e)] * len(frame)
            yield frame.assign(**{reply: replies})

    return requests.mapInPandas(run, schema)


def ask_once(requests: DataFrame, provider: Callable[[], Answer], reply: str, of: list[str], store: str, on_error: Callable[[Exception], str] | None = None) -> DataFrame:
    """``requests`` with a ``reply`` column, where requests that agree in the columns ``of`` are asked once, ever.

    Replies are kept under ``store``, a shared folder, by a hash of those columns. A batch that fails is not kept:
    it gets ``on_error``, or fails the call without one, after the others' replies are kept; so a repeated
    call asks for what is missing only.
    """
    spark = requests.sparkSession
    named = requests.withColumn("asked", F.sha2(F.to_json(F.struct(*of), {"ignoreNullFields": "false"}), 256))
    missing = named.select("asked", *of).dropDuplicates(["asked"]).join(kept_replies(spark, store), "asked", "left_anti")

    def told() -> Answer:
        answer = provider()
        return lambda frame: [{"reply": r, "failed": False} for r in answer(frame)]

    tried = ask(missing, told, "tried", "struct<reply:string,failed:boolean>", lambda e: {"reply": on_error(e) if on_error else str(e), "failed": True})
    tried = stored(tried.select("asked", "tried.*"), "replies")
    tried.filter("not failed").select("asked", "reply").write.mode("append").parquet(store)
    failed = tried.filter("failed").select("asked", "reply")
    if on_error is None and (first := failed.first()):
        raise RuntimeError(f"a provider failed: {first['reply']}")
    replies = kept_replies(spark, store).unionByName(failed).withColumnRenamed("reply", reply)
    return named.join(replies, "asked", "left").drop("asked")


def kept_replies(spark: SparkSession, store: str) -> DataFrame:
    """``asked, reply`` that are kept under a folder; none where it is not there yet. A reply that two runs kept counts once."""
    make_folder(spark, store)
    return spark.read.schema("asked string, reply string").parquet(store).groupBy("asked").agg(F.min("reply").alias("reply"))


def error_json(e: Exception) -> str:
    return json.dumps({"error": str(e)})


def stub_analysis() -> Answer:
    """Names the first line of the prompt's last paragraph as the brand."""

    def answer(frame: pd.DataFrame) -> list:
        names = frame["subject"].fillna("").str.strip()
        return [f"```json\n{json.dumps({'brand_name': n, 'generic_name': n.lower(), 'uses': ['use of ' + n], 'confidence': 0.5}, ensure_ascii=False)}\n```" for n in names]

    return answer


def unconfigured() -> Answer:
    return lambda frame: [json.dumps({"error": "no model is configured"})] * len(frame)


def stub_translation() -> Answer:
    """Marks each piece with its language; blank pieces fail."""
    return lambda frame: [f"[{lang}] {text}" if text.strip() else None for lang, text in zip(frame["language"], frame["chunk"])]


def stub_words() -> Answer:
    """Words of images whose bytes are UTF-8 text: confidence falls with the variant and with rotation."""

    def answer(frame: pd.DataFrame) -> list:
        out = []
        for content, variant, angle in zip(frame["content"], frame["variant"], frame["angle"]):
            words = bytes(content).decode("utf-8", "replace").split()
            out.append([{"word_idx": i, "text": w, "conf": 90.0 - variant - (0 if angle == 0 else 50)} for i, w in enumerate(words)])
        return out

    return answer


WORD_LIST = "array<struct<word_idx:int,text:string,conf:double>>"
