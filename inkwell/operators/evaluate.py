"""Scoring and evaluation tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.text import normalize_raw
from inkwell.functions.urls import looks_like_url, slug_text


def model_input(df: DataFrame, input_col: str, out: str = "text") -> DataFrame:
    """Model text from a headline, or from the slug when the input is a URL."""
    raw = F.coalesce(F.col(input_col), F.lit(""))
    return df.withColumn(out, normalize_raw(F.when(looks_like_url(raw), slug_text(raw)).otherwise(raw)))


def predict_table(model, df: DataFrame, key_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(key, *keep, prediction)`` from a fitted pipeline."""
    return model.transform(df).select(key_col, *keep, F.col("prediction").cast("int").alias("prediction"))


def predict_external(
    df: DataFrame,
    key_col: str,
    input_col: str,
    load: Callable[[], Callable[[list[str]], Sequence]],
    prediction_type: str = "int",
) -> DataFrame:
    """Score with any Python model.

    ``load`` builds the model once per Python worker stream; the model maps a
    list of texts to as many predictions (``predict`` method or plain call).
    """
    narrow = df.select(key_col, input_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        predict = getattr(model, "predict", model)
        for batch in batches:
            yield pd.DataFrame({key_col: batch[key_col], "prediction": list(predict(batch[input_col].tolist()))})

    key_type = narrow.schema[key_col].dataType.simpleString()
    return narrow.mapInPandas(run, f"{key_col} {key_type}, prediction {prediction_type}")


def accuracy(pred: DataFrame, label_col: str, pred_col: str, label_mapping: str = "exact") -> DataFrame:
    """Share of equal labels, one row ``(n, accuracy)``.

    ``label_mapping='best'``: a 0/1 side against a side with two other names, the
    better of both pairings; with any other number of names it falls back to text
    equality.
    """
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    label, guess = F.col(label_col).cast("string"), F.col(pred_col).cast("string")
    if label_mapping == "exact":
        return pred.agg(
            F.count(F.lit(1)).alias("n"), (F.count_if(label == guess) / n).alias("accuracy")
        )
    is_code = lambda c: F.bool_and(c.isin("0", "1"))
    lo, hi = F.min(label), F.max(label)
    one = {"_all": F.lit(0)}
    names = pred.agg(
        lo.alias("_lo"), hi.alias("_hi"), F.min(guess).alias("_glo"), F.max(guess).alias("_ghi"),
        is_code(label).alias("_label_codes"), is_code(guess).alias("_guess_codes"),
    ).withColumns(one)
    joined = pred.select(label.alias("_l"), guess.alias("_g")).withColumns(one).join(F.broadcast(names), "_all")
    coded = lambda c, lo_name, hi_name, first: F.when(F.col(c) == F.col(lo_name), str(first)).when(
        F.col(c) == F.col(hi_name), str(1 - first)
    )
    def hits(first: int):
        mapped = F.when(
            F.col("_guess_codes") & ~F.col("_label_codes"), coded("_l", "_lo", "_hi", first) == F.col("_g")
        ).when(
            F.col("_label_codes") & ~F.col("_guess_codes"), coded("_g", "_glo", "_ghi", first) == F.col("_l")
        ).otherwise(F.col("_l") == F.col("_g"))
        return F.count_if(mapped)

    two = lambda c: F.count_distinct(c) <= 2
    sides = joined.agg(
        F.count(F.lit(1)).alias("n"), hits(0).alias("_h0"), hits(1).alias("_h1"),
        F.count_if(F.col("_l") == F.col("_g")).alias("_eq"),
        (two("_l") & two("_g")).alias("_two"),
    )
    best = F.when(F.col("_two"), F.greatest("_h0", "_h1")).otherwise(F.col("_eq"))
    return sides.select("n", (best / F.greatest(F.col("n"), F.lit(1))).alias("accuracy"))


def confusion(pred: DataFrame, label_col: str, pred_col: str, classes: Sequence) -> DataFrame:
    """Counts over all (label, prediction) pairs of ``classes``, zeros kept."""
    counts = pred.groupBy(F.col(label_col).alias("label")).agg(
        *[F.count_if(F.col(pred_col) == F.lit(c)).alias(f"c{i}") for i, c in enumerate(classes)]
    )
    zero = pred.sparkSession.createDataFrame([(c,) for c in classes], ["label"]).withColumn(
        "label", F.col("label").cast(pred.schema[label_col].dataType)
    )
    full = zero.join(counts, "label", "left").na.fill(0)
    cells = F.array(*[F.struct(F.lit(c).alias("prediction"), F.col(f"c{i}").alias("n")) for i, c in enumerate(classes)])
    return full.select("label", F.inline(cells))


def class_report(pred: DataFrame, label_col: str, pred_col: str, classes: Sequence) -> DataFrame:
    """Precision, recall, F1, support per class plus macro and weighted rows; 0/0 is 0.

    The input is read once into ``3 * len(classes)`` counters.
    """
    label, guess = F.col(label_col), F.col(pred_col)
    counts = pred.agg(
        *[
            agg.alias(f"{name}{i}")
            for i, c in enumerate(classes)
            for name, agg in (
                ("t", F.count_if((label == F.lit(c)) & (guess == F.lit(c)))),
                ("p", F.count_if(guess == F.lit(c))),
                ("s", F.count_if(label == F.lit(c))),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(str(c)).alias("class"), *[F.col(f"{n}{i}").alias(n) for n in "tps"])
            for i, c in enumerate(classes)
        ]
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    per = counts.select(F.inline(rows)).withColumns(
        {"precision": ratio(F.col("t"), F.col("p")), "recall": ratio(F.col("t"), F.col("s"))}
    ).withColumn(
        "f1",
        F.coalesce(
            2 * F.col("precision") * F.col("recall")
            / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)),
            F.lit(0.0),
        ),
    ).withColumnRenamed("s", "support")
    names = ["precision", "recall", "f1"]
    macro = per.agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support"))
    weighted = per.agg(
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in names],
        F.sum("support").alias("support"),
    )
    out = ["class", *names, "support"]
    return (
        per.select(*out)
        .unionByName(macro.withColumn("class", F.lit("macro avg")).select(*out))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")).select(*out))
    )


def error_rate_by(pred: DataFrame, category: str, label_col: str, pred_col: str, min_n: int = 5) -> DataFrame:
    wrong = (F.col(label_col) != F.col(pred_col)).cast("int")
    return (
        pred.filter(F.col(category).isNotNull()).groupBy(category)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(wrong).alias("error_rate"))
        .filter(F.col("n") >= min_n)
    )


def compare_runs(runs: DataFrame, a: str = "stratified", b: str = "temporal") -> DataFrame:
    """Model by split table with the gap and the best model per split.

    ``runs``: ``(model, split, accuracy)``; the last word on a cell is its maximum.
    """
    wide = runs.groupBy("model").agg(
        F.max(F.when(F.col("split") == a, F.col("accuracy"))).alias(a),
        F.max(F.when(F.col("split") == b, F.col("accuracy"))).alias(b),
    )
    one = {"_all": F.lit(0)}
    best = wide.agg(F.max(a).alias("_a"), F.max(b).alias("_b")).withColumns(one)
    return (
        wide.withColumns(one).join(F.broadcast(best), "_all")
        .select(
            "model", a, b, (F.col(a) - F.col(b)).alias("gap"),
            (F.col(a) == F.col("_a")).alias(f"best_{a}"), (F.col(b) == F.col("_b")).alias(f"best_{b}"),
        )
    )


def best_run(runs: DataFrame, metric: str, key: str, n: int = 1) -> DataFrame:
    return runs.orderBy(F.col(metric).desc(), F.col(key).asc()).limit(n)
