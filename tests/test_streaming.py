import datetime as dt

from pyspark.sql import functions as F

from inkwell.session import scratch_path
from inkwell.streaming import articles as st


def test_late_rows_are_dropped(spark):
    source, sink = scratch_path(spark, "in"), scratch_path(spark, "out")
    day = lambda n: dt.datetime(2024, 1, n, 10, tzinfo=dt.timezone.utc)
    schema = "ts timestamp, outlet string"
    batches = [[(day(1), "A"), (day(5), "A")], [(day(9), "A"), (day(1), "A")], [(day(20), "B")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = st.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        st.drain(st.stream_volume(stream, "ts", "outlet", "1 day", "1 day"), f"{sink}/t", f"{sink}/c")
    got = {(r["d"], r["outlet"]): r["n"] for r in spark.read.parquet(f"{sink}/t").select(F.to_date("window_start").alias("d"), "outlet", "n").collect()}
    assert got == {(dt.date(2024, 1, 1), "A"): 1, (dt.date(2024, 1, 5), "A"): 1, (dt.date(2024, 1, 9), "A"): 1}
    monthly = st.monthly_volume(spark.read.parquet(f"{sink}/t"), "outlet").collect()
    assert [(r["month"], r["n"]) for r in monthly] == [(dt.date(2024, 1, 1), 3)]


def test_streams_read_tables_of_one_file_and_of_many(spark):
    from inkwell.plans import QUERIES

    d, given = scratch_path(spark, "tables"), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{given}/documents.parquet").limit(60)
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    assert QUERIES["stream_score"](spark, d).count() == 60
    events = spark.read.parquet(f"{given}/events.parquet").limit(100)
    events.repartition(2).write.parquet(f"{d}/events.parquet")
    for name in ("stream_volume", "stream_dedup_articles"):
        assert QUERIES[name](spark, d).count() > 0
    assert QUERIES["stream_volume"](spark, given).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{given}/events.parquet").filter("event_type is not null").count()
