"""Row hygiene: missing cells, labels, duplicates, backfill, key sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inkwell.functions.text import clean_strict, is_missing, strip


def drop_missing(df: DataFrame, cols: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows lacking ``any`` (or only rows lacking ``all``) of the columns."""
    if how not in ("any", "all"):
        raise ValueError("how must be 'any' or 'all'")
    tests = [is_missing(F.col(c)) for c in cols]
    lacking = reduce((lambda a, b: a | b) if how == "any" else (lambda a, b: a & b), tests)
    return df.filter(~lacking)


def encode_label(col: Column, positive: str) -> Column:
    return (col == F.lit(positive)).cast("int")


def coerce_labels(
    col: Column,
    tokens: dict[int, Sequence[str]],
    contains: dict[int, Sequence[str]] | None = None,
    prefixes: dict[int, Sequence[str]] | None = None,
    strict: bool = True,
) -> Column:
    """Free-form label text to 0/1: exact tokens first, then substrings and prefixes.

    Unmapped values fail the job when ``strict`` and become NULL otherwise.
    """
    value = F.lower(strip(F.coalesce(col.cast("string"), F.lit(""))))
    label = F
    for code, names in tokens.items():
        label = label.when(value.isin(*names), F.lit(code))
    for code in tokens:
        tests = [value.contains(p) for p in (contains or {}).get(code, ())]
        tests += [value.startswith(p) for p in (prefixes or {}).get(code, ())]
        if tests:
            label = label.when(reduce(lambda a, b: a | b, tests), F.lit(code))
    if strict:
        return label.otherwise(F.raise_error(F.concat(F.lit("unmapped label: "), value)).cast("int"))
    return label.otherwise(F.lit(None).cast("int"))


def select_final(df: DataFrame, ids: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    return df.select(*ids, *features, label)


def dedup_text(
    df: DataFrame,
    text_col: str,
    source_col: str,
    order_col: str,
    cleaner: Callable[[Column], Column] = clean_strict,
) -> DataFrame:
    """First row per (cleaned text, source) by ``order_col``; empty cleaned texts go.

    ``order_col`` is a unique key.  Only digests and keys take part in the
    grouping, with fixed-size counters combined map-side, so a text that makes up
    a third of the table shrinks to one row per task before the shuffle; whole
    rows are then picked by their key, which has no hot value.
    """
    cleaned = df.withColumn("text_clean", cleaner(F.col(text_col)))
    # Empty texts are told by an aggregate: a filter on the cleaned text would be
    # pushed below the grouping and clean every text a second time.
    winners = (
        cleaned.groupBy(F.sha2("text_clean", 256).alias("_digest"), F.col(source_col).alias("_source"))
        .agg(F.min(order_col).alias(order_col), F.max(F.length("text_clean")).alias("_length"))
        .filter(F.col("_length") > 0)
        .select(order_col)
    )
    return cleaned.join(winners, order_col, "left_semi")


def drop_cross_group_dupes(df: DataFrame, text_col: str, group_col: str) -> DataFrame:
    """Remove texts that occur in more than one group."""
    marked = df.withColumn("_digest", F.sha2(F.col(text_col), 256))
    shared = (
        marked.groupBy("_digest")
        .agg(F.min(group_col).alias("_lo"), F.max(group_col).alias("_hi"))
        .filter(F.col("_lo") != F.col("_hi"))
    )
    return marked.join(shared, "_digest", "left_anti").drop("_digest")


def unseen(candidates: DataFrame, seen: DataFrame, key_col: str = "url") -> DataFrame:
    """Candidates whose trimmed key was not collected before."""
    left = candidates.withColumn("_key", strip(F.col(key_col)))
    right = seen.select(strip(F.col(key_col)).alias("_key")).distinct()
    return left.join(right, "_key", "left_anti").drop("_key")


def attach_topics(articles: DataFrame, topics: DataFrame, on: str, assert_unique: bool = False) -> DataFrame:
    """Left join; repeated keys in ``topics`` repeat rows unless ``assert_unique``."""
    if assert_unique and not topics.groupBy(on).count().filter("count > 1").isEmpty():
        raise ValueError(f"topics hold repeated {on} values")
    return articles.join(topics, on, "left")


def decode(df: DataFrame, col: str, mapping: DataFrame, key: str, label: str, out: str) -> DataFrame:
    """Replace codes by labels from a mapping table."""
    names = mapping.select(F.col(key).alias("_code"), F.col(label).alias(out))
    return df.join(names, df[col] == F.col("_code"), "left").drop("_code")


def missing_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sizes of the missing sets of two columns, in one pass."""
    miss_a, miss_b = is_missing(F.col(a)), is_missing(F.col(b))
    return df.agg(
        F.count_if(miss_a).alias("missing_a"),
        F.count_if(miss_b).alias("missing_b"),
        F.count_if(miss_a & miss_b).alias("missing_both"),
        F.count_if(miss_a & ~miss_b).alias("missing_a_only"),
    )


def backfill(
    base: DataFrame, patch: DataFrame, key_col: str, cols: Sequence[str], order_col: str | None = None
) -> DataFrame:
    """Fill missing cells of ``base`` from ``patch``; present cells never change.

    The patch is cut to one row per key first, so the join cannot multiply rows;
    ``filled_<col>`` flags tell what was filled.
    """
    keyed = patch.withColumn("_key", strip(F.col(key_col)))
    order = F.col(order_col) if order_col else F.struct(*cols)
    one = keyed.groupBy("_key").agg(F.min_by(F.struct(*cols), order).alias("_patch"))
    joined = base.withColumn("_key", strip(F.col(key_col))).join(one, "_key", "left")
    changes = {}
    for c in cols:
        offer = F.col(f"_patch.{c}")
        fill = is_missing(F.col(c)) & ~is_missing(offer)
        changes[f"filled_{c}"] = fill.cast("int")
        changes[c] = F.when(is_missing(F.col(c)), offer).otherwise(F.col(c))
    return joined.withColumns(changes).drop("_key", "_patch")


def backfill_counts(filled: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cells filled per column, as one row."""
    return filled.agg(*[F.sum(f"filled_{c}").alias(c) for c in cols])


def collapse_rare(
    df: DataFrame, col: str, min_n: int = 5, preserve: Sequence[str] = (), other: str = "other"
) -> DataFrame:
    """Values with fewer than ``min_n`` rows become ``other``, except preserved ones.

    Counts are aggregated apart and joined back: rows do not travel the way a
    window over the value would make them.  A rare value has under ``min_n`` rows,
    so the joined side holds no hot key.
    """
    rare = (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") < min_n) & ~F.col("_value").isin(*preserve) if preserve else F.col("_n") < min_n)
        .select("_value", F.lit(True).alias("_rare"))
    )
    return (
        df.join(rare, F.col(col) == F.col("_value"), "left")
        .withColumn(col, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(col)))
        .drop("_value", "_rare")
    )


def restrict_shared(df: DataFrame, key_col: str, group_col: str, groups: Sequence[str], min_n: int = 10) -> DataFrame:
    """Rows whose key occurs more than ``min_n`` times in every group."""
    per_group = [
        F.count_if(F.col(group_col) == F.lit(g)).alias(f"_n{i}") for i, g in enumerate(groups)
    ]
    shared = df.filter(F.col(key_col).isNotNull()).groupBy(key_col).agg(*per_group)
    for i in range(len(groups)):
        shared = shared.filter(F.col(f"_n{i}") > min_n)
    return df.join(shared.select(key_col), key_col, "left_semi")


def _keys(df: DataFrame, key_col: str) -> DataFrame:
    return df.select(key_col).filter(F.col(key_col).isNotNull())


def key_union(a: DataFrame, b: DataFrame, key_col: str) -> DataFrame:
    return _keys(a, key_col).union(_keys(b, key_col)).distinct()


def key_intersect(a: DataFrame, b: DataFrame, key_col: str) -> DataFrame:
    return _keys(a, key_col).intersect(_keys(b, key_col))


def key_except(a: DataFrame, b: DataFrame, key_col: str) -> DataFrame:
    return _keys(a, key_col).subtract(_keys(b, key_col))


def coverage_check(expected: DataFrame, got: DataFrame, key_col: str) -> DataFrame:
    """Row counts on both sides and keys found on one side only, as one row."""
    def tally(df: DataFrame, side: str) -> DataFrame:
        keys = df.groupBy(key_col).agg(F.count(F.lit(1)).alias("n"))
        return keys.select(key_col, F.lit(side).alias("side"), "n")

    sides = tally(expected, "expected").unionByName(tally(got, "got"))
    per_key = sides.groupBy(key_col).agg(
        F.sum(F.when(F.col("side") == "expected", F.col("n"))).alias("e"),
        F.sum(F.when(F.col("side") == "got", F.col("n"))).alias("g"),
    )
    return per_key.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("got_rows"),
        F.count_if(F.col("g").isNull()).alias("keys_not_got"),
        F.count_if(F.col("e").isNull()).alias("keys_not_expected"),
    ).withColumn("complete", (F.col("keys_not_got") == 0) & (F.col("expected_rows") == F.col("got_rows")))


def error_rows(pred: DataFrame, label_col: str, pred_col: str, direction: int | None = None) -> DataFrame:
    """Mispredicted rows; ``direction`` keeps those wrongly predicted as that class."""
    wrong = pred.filter(F.col(label_col) != F.col(pred_col))
    return wrong if direction is None else wrong.filter(F.col(pred_col) == F.lit(direction))
