"""Reading, stacking and writing article tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from inkwell.functions.urls import looks_like_url

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType(), True)
        for name in ("url", "topic", "title", "subtitle", "author", "datetime_posted", "label")
    ]
)

# Column names that reveal a role.
HEADLINE_NAMES = ("headline", "title", "text", "news_headline", "article_title", "content")
URL_NAMES = ("url", "link", "article_url", "page_url")
LABEL_NAMES = ("label", "labels", "source", "news_source", "class", "target", "y")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns {lacking}; found {df.columns}")
    return df


def read_articles(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = ARTICLE_SCHEMA,
    required: Sequence[str] = ("url", "title"),
    fmt: str = "csv",
) -> DataFrame:
    """Article table from CSV (quoted multi-line fields, BOM tolerated) or a columnar format.

    CSV columns are matched by header name, so files may order them differently
    or lack optional ones.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt != "csv":
        return require_columns(spark.read.format(fmt).load(paths), required)
    options = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}
    headers = [
        [c.strip("\ufeff\"") for c in spark.read.options(header=True).csv(p).columns] for p in paths
    ]
    types = {f.name: f.dataType for f in schema}
    frames = []
    for file, header in zip(paths, headers):
        lacking = [c for c in required if c not in header]
        if lacking:
            raise ValueError(f"missing columns {lacking} in {file}; found {header}")
        as_read = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        frames.append(spark.read.schema(as_read).options(**options).csv(file))
    return union_batches(frames)


def union_batches(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack batches by column name; a column absent from a batch is NULL there."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked


def stack_sources(frames: dict[str, DataFrame], tag: str = "outlet") -> DataFrame:
    return union_batches([df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def discover_roles(df: DataFrame, threshold: float = 0.5) -> dict[str, str | None]:
    """Which columns hold headline, URL and label: by name, else by content.

    The content test is the share of URL-like values in the whole column, measured
    for all text columns in one aggregate.
    """
    names = {c.lower(): c for c in df.columns}

    def named(candidates: Sequence[str], taken: Sequence[str | None]) -> str | None:
        return next((names[c] for c in candidates if names.get(c, None) and names[c] not in taken), None)

    text_cols = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    shares: dict[str, float] = {}

    def url_like(column: str) -> bool:
        if not shares and text_cols:
            tests = [
                F.avg(F.coalesce(looks_like_url(F.col(c)), F.lit(False)).cast("int")).alias(c)
                for c in text_cols
            ]
            shares.update(df.agg(*tests).first().asDict())
        return (shares.get(column) or 0.0) >= threshold

    url = named(URL_NAMES, ()) or next((c for c in text_cols if url_like(c)), None)
    label = named(LABEL_NAMES, (url,))
    headline = named(HEADLINE_NAMES, (url, label))
    if headline is None:
        headline = next((c for c in df.columns if c not in (url, label) and not url_like(c)), url)
    return {"headline": headline, "url": url, "label": label}


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def quarantine(df: DataFrame, rules: dict[str, Column], key_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; rejected rows are ``(key, error)`` with the first broken rule."""
    error = F
    for message, broken in rules.items():
        error = error.when(F.coalesce(broken, F.lit(False)), F.lit(message))
    checked = df.withColumn("_error", error.otherwise(F.lit(None).cast("string")))
    accepted = checked.filter(F.col("_error").isNull()).drop("_error")
    rejected = checked.filter(F.col("_error").isNotNull()).select(key_col, F.col("_error").alias("error"))
    return accepted, rejected


def write_quarantined(
    df: DataFrame, rules: dict[str, Column], accepted_path: str, rejected_path: str, key_col: str = "url"
) -> None:
    accepted, rejected = quarantine(df, rules, key_col)
    write_table(accepted, accepted_path)
    write_table(rejected, rejected_path)


def write_vectors(df: DataFrame, key_col: str, vector_col: str, path: str) -> None:
    write_table(df.select(key_col, F.col(vector_col).cast("array<float>")), path)


def read_vectors(spark: SparkSession, path: str, keys: DataFrame, key_col: str) -> DataFrame:
    """Stored vectors, checked to match ``keys`` one to one."""
    vectors = spark.read.parquet(path)
    have = vectors.groupBy(key_col).agg(F.count(F.lit(1)).alias("_n"))
    want = keys.select(key_col).distinct().withColumn("_want", F.lit(1))
    odd = have.join(want, key_col, "full_outer").filter(
        F.col("_n").isNull() | F.col("_want").isNull() | (F.col("_n") != 1)
    )
    if not odd.isEmpty():
        raise ValueError("vectors and keys do not match one to one")
    return vectors
