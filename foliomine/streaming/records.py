"""Streams over logs and records: counts, bounded history, resumable upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def event_time(df: DataFrame, column: str) -> DataFrame:
    """A watermark needs a timestamp with a zone; a time without one is read as UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def daily_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", late: str = "1 day") -> DataFrame:
    """``day, by, n``; on a stream rows later than ``late`` are left out."""
    df = event_time(events, ts)
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.window(ts, "1 day").alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), by, "n")


def bounded_history(turns: DataFrame, n: int = 20, key: str = "user_email") -> DataFrame:
    """``key, entries``: the last n entries per user, kept as state; turns of a batch are taken by time and id."""

    def step(who: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["created_at", "id"])
        for q, a in zip(rows["question"], rows["answer"], strict=True):
            held += [f"User: {'' if pd.isna(q) else q}", f"Assistant: {'' if pd.isna(a) else a}"]
        held = held[-n:]
        state.update((held,))
        yield pd.DataFrame({key: [who[0]], "entries": [held]})

    kept = turns.where(F.col(key).isNotNull()).select(key, "created_at", "id", "question", "answer")
    return kept.groupBy(key).applyInPandasWithState(step, f"{key} string, entries array<string>", "entries array<string>", "update", "NoTimeout")


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: str = "id", order: str = "loaded_at", tie: str | None = None) -> StreamingQuery:
    """Load what is there and stop; each batch is written once more after a failure, under its own number.

    Of each key a batch keeps its latest version by ``order``, ties by ``tie`` (the key by default).
    """

    def write(batch: DataFrame, number: int) -> None:
        from foliomine.operators.logs import latest_version

        latest_version(batch, [key], order, tie or order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted_table(spark, target: str, key: str = "id", order: str = "loaded_at", tie: str | None = None) -> DataFrame:
    """The table a stream of upserts left: of each id the latest version by ``order``, whichever batch brought it.

    Versions that are equal in ``order`` and ``tie`` fall to the later batch.
    """
    df = spark.read.parquet(target)
    rest = [c for c in df.columns if c not in (key, "batch")]
    last = F.max_by(F.struct(*rest), F.struct(order, tie or order, "batch"))
    return df.groupBy(key).agg(last.alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def compacted(spark, target: str, into: str, key: str = "id", order: str = "loaded_at", tie: str | None = None) -> None:
    """The latest versions written anew as one batch: a long stream's table is replaced by this from time to time."""
    upserted_table(spark, target, key, order, tie).write.mode("overwrite").parquet(f"{into}/batch=0")
