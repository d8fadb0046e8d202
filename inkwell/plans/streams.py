"""Queries: streams drained into files and read back."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.functions.text import is_missing
from inkwell.operators import models as md
from inkwell.plans.learning import _labelled, _parts, _word_view
from inkwell.plans.registry import query
from inkwell.plans.views import table
from inkwell.session import scratch_path
from inkwell.streaming import articles as st


def _stream(spark, d, name):
    # a table is one file or a folder of files; a glob is listed in either case
    return st.read_stream(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)


def _drained(spark, stream, label):
    sink = scratch_path(spark, label)
    st.drain(stream, f"{sink}/out", f"{sink}/state")
    return spark.read.schema(stream.schema).parquet(f"{sink}/out")


@query("SELECT DISTINCT 'user/' || user_id || '/' || event_type AS url FROM events")
def stream_dedup_articles(spark, d):
    events = _stream(spark, d, "events")
    url = F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    seen = st.stream_dedup_articles(events.select(url.alias("url"), F.col("ts").cast("timestamp").alias("ts")), ["url"], "ts", "60 days")
    return _drained(spark, seen.select("url"), "dedup")


@query("""SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events
    WHERE event_type IS NOT NULL GROUP BY 1, 2""")
def stream_volume(spark, d):
    events = _stream(spark, d, "events").withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))
    daily = st.stream_volume(events, "ts", "event_type", "1 day", "1 day")
    sink = scratch_path(spark, "volume")
    st.drain_updates(daily, f"{sink}/out", f"{sink}/state")
    drained = st.latest(spark.read.parquet(f"{sink}/out"), ["window_start", "event_type"])
    return drained.select(F.to_date("window_start").alias("day"), "event_type", "n")


@query()
def stream_score(spark, d):
    train, _ = _parts(_labelled(spark, d))
    model = Pipeline(stages=[*_word_view(), md.naive_bayes("multinomial")]).fit(train)
    sink = scratch_path(spark, "score")
    docs = _stream(spark, d, "documents").select("doc_id", "text").withColumn("text_clean", tx.clean_strict(F.col("text")))
    rules = {"empty text": is_missing(F.col("text_clean"))}
    st.stream_score(docs, model, rules, "doc_id", f"{sink}/ok", f"{sink}/bad", f"{sink}/state")
    return spark.read.parquet(f"{sink}/ok").select("doc_id", "prediction")
