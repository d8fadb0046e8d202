"""Incremental forms: deduplicated intake, running volume, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from inkwell.sources.articles import quarantine


def read_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, fmt: str = "parquet") -> DataFrame:
    """File stream over a folder, optionally limited to file names matching a glob."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def stream_dedup_articles(stream: DataFrame, key_cols: Sequence[str], ts_col: str, delay: str = "7 days") -> DataFrame:
    """First sight of each key; state for a key is dropped ``delay`` after its event time."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(list(key_cols))


def stream_volume(stream: DataFrame, ts_col: str, by: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Tumbling windows per group: append mode gives closed ones, update mode every change.

    Months are a batch roll-up of the daily sink (a month is no fixed window).
    """
    return (
        stream.filter(F.col(by).isNotNull())
        .withWatermark(ts_col, delay)
        .groupBy(F.window(ts_col, window), by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), by, "n")
    )


def monthly_volume(daily: DataFrame, by: str) -> DataFrame:
    month = F.trunc(F.to_date("window_start"), "month").alias("month")
    return daily.groupBy(month, by).agg(F.sum("n").alias("n"))


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> list[dict]:
    """Run a stream over all available input into a Parquet folder; returns its progress."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.jsonValue if hasattr(p, "jsonValue") else p for p in query.recentProgress]


def drain_updates(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Write every changed row of an aggregating stream into a folder named by its batch.

    Windows that are still open when the input ends are there too, and a replayed
    batch overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest(updates: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """The last written value of every key."""
    return updates.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def stream_score(
    stream: DataFrame, model, rules: dict[str, Column], key_col: str, sink: str, rejected_sink: str, checkpoint: str,
) -> None:
    """Score incoming rows with a saved pipeline; rows breaking a rule go to quarantine.

    Each batch lands in a folder named by its id and is overwritten on replay, so
    a restart after a lost driver writes nothing twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = quarantine(batch, rules, key_col)
        scored = model.transform(accepted).select(key_col, F.col("prediction").cast("int").alias("prediction"))
        scored.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{rejected_sink}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
