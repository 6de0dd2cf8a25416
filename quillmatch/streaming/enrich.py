"""Streams (an extension): match names as they arrive, and watch latency in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmatch.operators.match import MatchIndex, top_k


def match_stream(names: DataFrame, index: MatchIndex, out: str, checkpoint: str, k: int = 3, once: bool = True) -> StreamingQuery:
    """Matches a stream ``names(qid, query)`` against a fitted index; each batch's result lands under its own number, so a repeated batch replaces itself."""

    def land(batch: DataFrame, number: int) -> None:
        top_k(index, batch, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = names.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latency_windows(metrics: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``window, endpoint, n, mean_ms, worst_ms`` of a stream of metrics with ``created_at``; rows later than ``late`` are ignored."""
    timed = metrics.withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", width), "endpoint").agg(F.count("*").alias("n"), F.avg("response_time_ms").alias("mean_ms"), F.max("response_time_ms").alias("worst_ms"))
