"""The given tables, and the article view the operators run on."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.session import spread

STORY_EVENTS = (
    ("launch", datetime(2024, 1, 8, 12, 0)),
    ("debate", datetime(2024, 1, 15)),
    ("final", datetime(2024, 1, 24, 18, 30)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _outlet():
    return F.when(F.col("lang") == "en", "A").otherwise("B").alias("outlet")


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts with outlet (by language) and category (by source)."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", F.col("text").alias("title"), "lang", F.col("source").alias("category"), _outlet()
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines joined to an event (date, author, topic) and labels; gaps come from the labels."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").alias("d")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id").alias("e")
    labels = table(spark, sf_dir, "labels").alias("l")
    return (
        docs.join(events, F.col("e.event_id") == F.col("d.doc_id") * 10, "left")
        .join(labels, F.col("l.doc_id") == F.col("d.doc_id"), "left")
        .select(
            F.col("d.doc_id"), F.col("text").alias("title"),
            F.nullif(F.split_part(F.col("text"), F.lit("\n"), F.lit(2)), F.lit("")).alias("subtitle"),
            "lang", F.col("source").alias("category"), _outlet(),
            F.col("event_type").alias("topic"),
            F.when(F.col("toxic") == 1, None).otherwise(F.col("ts")).alias("ts"),
            F.when(F.col("quality") == 0, "  ")
            .otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("author"),
            "quality", "toxic",
        )
    )


def story_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STORY_EVENTS), "event string, event_ts timestamp_ntz")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
