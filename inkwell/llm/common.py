"""Scratch tables, null-safe inputs and connected components shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.session import scratch_path

#: ASCII white space, as the contracts define words: runs of anything else.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    return scratch_path(spark, label)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder, which outlives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def enclosed(docs: DataFrame, **named: str) -> DataFrame:
    """The named columns under fixed names, and all columns of the row in one struct ``own``.

    Helper columns added to it cannot clash with the documents' own.
    """
    return docs.select(*(F.col(c).alias(name) for name, c in named.items()), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest reachable node.

    Rounds of large-star and small-star rewriting: a node's neighbourhood is
    reduced with min aggregates only, so a hub is never held in one task, and the
    link table never grows beyond a constant times its first size.  Each round is
    written to the shared folder; the loop ends when a round changes nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    edges = stored(edges, label)

    def state(table: DataFrame) -> tuple:
        """Rows and their hashes summed: equal for equal tables."""
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    before = state(edges)
    while True:
        both = edges.select(F.col("hi").alias("v"), F.col("lo").alias("w")).union(
            edges.select(F.col("lo").alias("v"), F.col("hi").alias("w"))
        )
        least = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
        # large star: every neighbour above v is hung below v's smallest neighbour
        large = (
            both.join(least, "v").where("w > v").select(F.col("w").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo").distinct()
        )
        large = stored(large, label)
        # small star: the neighbours below v, and v itself, are hung below the smallest of them
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(floor, "hi")
        small = (
            joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(joined.select("hi", F.col("m").alias("lo")))
            .where("hi <> lo").distinct()
        )
        small = stored(small, label)
        edges, after = small, state(small)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return nodes.union(roots)
