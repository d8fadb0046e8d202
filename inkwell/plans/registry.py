"""Registry of named queries with their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL fragments shared by the oracle texts, written as @name in them.
FRAGMENTS = {
    "headlines": """headlines AS (
        SELECT doc_id, text AS title, lang, source AS category,
               CASE WHEN lang = 'en' THEN 'A' ELSE 'B' END AS outlet
        FROM documents)""",
    "articles": """articles AS (
        SELECT d.doc_id, d.text AS title, nullif(split_part(d.text, chr(10), 2), '') AS subtitle,
               d.lang, d.source AS category, CASE WHEN d.lang = 'en' THEN 'A' ELSE 'B' END AS outlet,
               e.event_type AS topic, CASE WHEN l.toxic = 1 THEN NULL ELSE e.ts END AS ts,
               CASE WHEN l.quality = 0 THEN '  ' ELSE 'user ' || e.user_id END AS author,
               l.quality, l.toxic
        FROM documents d
        LEFT JOIN events e ON e.event_id = d.doc_id * 10
        LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "story_events": """story_events AS (
        SELECT * FROM (VALUES ('launch', TIMESTAMP '2024-01-08 12:00:00'),
                              ('debate', TIMESTAMP '2024-01-15 00:00:00'),
                              ('final', TIMESTAMP '2024-01-24 18:30:00')) AS v(event, event_ts))""",
}


def tidy(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats rounded to 6 digits, as in the SQL texts."""
    out = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        out.append(column.alias(field.name))
    return df.select(*out)


def expand(sql: str) -> str:
    return re.sub(r"@(\w+)", lambda m: FRAGMENTS.get(m.group(1), m.group(0)), sql)


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL when there is one."""

    def add(function):
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, sf_dir: tidy(function(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = expand(sql)
        return function

    return add
