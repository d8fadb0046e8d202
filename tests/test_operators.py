import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import evaluate as ev, features as ft, hygiene as hy, profile as pf, ranking as rk, splits as sp, temporal as tm
from inkwell.sources import articles as src
from inkwell.session import scratch_path


@pytest.fixture(scope="module")
def dated(spark):
    """Half of the rows share one timestamp, as a hot key would."""
    rng = random.Random(1)
    noon = dt.datetime(2024, 1, 5, 12)
    rows = []
    for i in range(600):
        ts = noon if i % 2 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(20_000))
        rows.append((i, "A" if rng.random() < 0.7 else "B", None if i % 50 == 0 else ts))
    return spark.createDataFrame(rows, "key int, outlet string, ts timestamp_ntz").repartition(7)


def md5(key):
    import hashlib

    return hashlib.md5(str(key).encode()).hexdigest()


@pytest.mark.parametrize("small_bucket", [0, 10, 10_000])
def test_nth_rows_equals_sorting(spark, dated, small_bucket):
    rows = [r for r in dated.collect() if r["ts"]]
    order = sorted(rows, key=lambda r: (r["ts"], md5(r["key"])))
    targets = spark.createDataFrame([(i, k) for i, k in enumerate((1, 100, 333, len(order)))], "target int, k bigint")
    tie = rk.hash_key(F.col("key"))
    got = rk.nth_rows(dated.filter("ts is not null"), [], rk.time_levels(F.col("ts"), tie), targets, small_bucket)
    found = {r["target"]: (r["_ts"], r["_tie"]) for r in got.collect()}
    for i, k in enumerate((1, 100, 333, len(order))):
        assert found[i] == (order[k - 1]["ts"], md5(order[k - 1]["key"]))


def test_splits_do_not_depend_on_partitioning(spark, dated):
    for split in (
        lambda df: sp.temporal_split(df, "ts", "key", 0.8),
        lambda df: sp.time_stratified_split(df, "outlet", "ts", "key", 0.2),
        lambda df: sp.stratified_split(df, "outlet", "key", 0.2, 5),
    ):
        first = {r["key"]: r["split"] for r in split(dated).collect()}
        again = {r["key"]: r["split"] for r in split(dated.repartition(3, "outlet")).collect()}
        assert first == again and len(first) == 600


def test_time_stratified_split_is_newest_last(dated):
    rows = sp.time_stratified_split(dated, "outlet", "ts", "key", 0.2).collect()
    for outlet in "AB":
        mine = [r for r in rows if r["outlet"] == outlet]
        test = [r["ts"] for r in mine if r["split"] == "test"]
        train = [r["ts"] for r in mine if r["split"] == "train" and r["ts"]]
        assert len(test) == max(1, round(0.2 * len([r for r in mine if r["ts"]])))
        assert max(train) <= min(test)
    assert all(r["split"] == "train" for r in rows if r["ts"] is None)


def test_rolling_folds_are_nested_prefixes(dated):
    folds = sp.rolling_folds(dated, "ts", "key", 4).collect()
    train = {f: {r["key"] for r in folds if r["fold"] == f and r["role"] == "train"} for f in range(4)}
    held = {f: {r["key"] for r in folds if r["fold"] == f and r["role"] == "validate"} for f in range(4)}
    dated_rows = 588
    for f in range(4):
        assert len(held[f]) == dated_rows // 5 and not held[f] & train[f]
        if f:
            assert train[f] == train[f - 1] | held[f - 1]


def test_backfill_never_changes_present_cells(spark):
    base = spark.createDataFrame([("a", "x"), ("b", " "), ("b", None), ("c", None)], "key string, author string")
    patch = spark.createDataFrame([(" b ", "P2"), ("b", "P1"), ("a", "other"), ("c", " ")], "key string, author string")
    filled = hy.backfill(base, patch, "key", ["author"])
    assert hy.backfill_counts(filled, ["author"]).first()["author"] == 2
    got = sorted(map(tuple, filled.select("key", "author", "filled_author").collect()), key=str)
    assert got == [("a", "x", 0), ("b", "P1", 1), ("b", "P1", 1), ("c", " ", 0)]


def test_dedup_keeps_first_and_collapses_hot_text(spark):
    rows = [(i, "same Text!" if i % 3 else f"own {i}", "A") for i in range(300)] + [(999, " !! ", "A")]
    out = hy.dedup_text(spark.createDataFrame(rows, "key int, title string, outlet string").repartition(5), "title", "outlet", "key")
    keys = sorted(r["key"] for r in out.collect())
    assert keys == sorted([1] + [i for i in range(300) if i % 3 == 0])


def test_labels(spark):
    df = spark.createDataFrame([(" Alpha ",), ("alphanews x",), ("0",), ("beta",), ("zzz",)], "label string")
    tokens, contains, prefixes = {0: ("alpha", "0"), 1: ("beta", "1")}, {0: ("alphanews",)}, {1: ("be",)}
    label = hy.coerce_labels(F.col("label"), tokens, contains, prefixes, strict=False)
    assert [r[0] for r in df.select(label).collect()] == [0, 0, 0, 1, None]
    with pytest.raises(Exception, match="unmapped label"):
        df.select(hy.coerce_labels(F.col("label"), tokens)).collect()


def test_accuracy_best_mapping(spark):
    df = spark.createDataFrame([("x", 0), ("x", 0), ("y", 1), ("y", 0)], "label string, pred int")
    assert ev.accuracy(df, "label", "pred").first()["accuracy"] == 0.0
    assert ev.accuracy(df, "label", "pred", "best").first()["accuracy"] == 0.75
    codes = spark.createDataFrame([(0, 1), (1, 0)], "label int, pred int")
    assert ev.accuracy(codes, "label", "pred", "best").first()["accuracy"] == 0.0


def test_lowess_on_a_line_and_against_direct_fit(spark):
    x = np.arange(12.0)
    assert np.allclose(tm.lowess_fit(x, 3 * x + 1, 2 / 3, 3), 3 * x + 1)
    y = np.sin(x)
    plain = tm.lowess_fit(x, y, 2 / 3, 0)
    i, near = 4, 8
    reach = np.sort(np.abs(x - x[i]))[near - 1]
    w = np.clip(1 - (np.abs(x - x[i]) / reach) ** 3, 0, None) ** 3
    a = np.vstack([np.ones_like(x), x]).T
    beta = np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * y))
    assert plain[i] == pytest.approx(beta[0] + beta[1] * x[i])


def test_correlation_p_values():
    # Two-sided t probabilities from published tables: t(10) = 2.228 and t(5) = 2.571 at 5 %.
    for dof, t in ((10, 2.228139), (5, 2.570582), (30, 2.042272)):
        rho = t / (t * t + dof) ** 0.5
        assert tm._correlation_p(rho, dof + 2) == pytest.approx(0.05, abs=1e-5)


def test_event_window_is_inclusive(spark):
    events = spark.createDataFrame([("e", dt.datetime(2024, 1, 10))], "event string, event_ts timestamp_ntz")
    stamps = [dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 12), dt.datetime(2024, 1, 12, 0, 0, 1), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stamps)], "key int, ts timestamp_ntz")
    assert {r["key"] for r in tm.in_event_window(df, events, "ts", 2).collect()} == {0, 1}
    flags = {r["key"]: r["in_any_event"] for r in tm.event_mask(df, events, "ts", 2).collect()}
    assert flags == {0: True, 1: True, 2: False, 3: False}


def test_effect_size_without_variance_is_null(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1), ("B", 1), ("B", 1)], "g string, f int")
    assert pf.effect_size(df, "g", "A", "B", ["f"]).first()["cohens_d"] is None


def test_sources_round_trip(spark):
    path = scratch_path(spark, "csv")
    rows = [("https://a/1", 'He said "x",\nthen left', None), ("https://a/2", " spaced ", "s")]
    df = spark.createDataFrame(rows, "url string, title string, subtitle string")
    src.write_table(df, path, "csv")
    back = src.read_articles(spark, path)
    assert {(r["url"], r["title"], r["subtitle"]) for r in back.collect()} == set(rows)
    with pytest.raises(ValueError, match="missing columns"):
        src.read_articles(spark, path, required=("nope",))


def test_discover_roles_by_content(spark):
    df = spark.createDataFrame([("https://a/b", "Some words", "x")] * 3, "place string, words string, y string")
    assert src.discover_roles(df) == {"headline": "words", "url": "place", "label": "y"}


def test_vectors_round_trip_and_mismatch(spark):
    path = scratch_path(spark, "vectors")
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [2.0, 3.0])], "k int, v array<double>")
    src.write_vectors(df, "k", "v", path)
    assert src.read_vectors(spark, path, df, "k").count() == 2
    with pytest.raises(ValueError, match="one to one"):
        src.read_vectors(spark, path, df.filter("k = 1"), "k")
    with pytest.raises(ValueError, match="one to one"):
        ft.fuse_features(df.select("k", F.lit(1.0).alias("f")).filter("k = 1"), df, "k", ["f"], "v")


def test_overlap_counts_outliers_and_nulls_in_the_total_only(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (-1, 0), (-1, -1), (None, 1), (1, None)]
    cells = pf.overlap_matrix(spark.createDataFrame(rows, "a int, b int"), "a", "b", exclude=[-1]).collect()
    got = {(r["a"], r["b"]): r["percent"] for r in cells}
    assert got == {(0, 0): 25.0, (0, 1): 12.5, (1, 0): 0.0, (1, 1): 12.5}
