"""Quantiles per group against numpy."""

import math
import random

import numpy as np
import pytest

from inkwell.operators import quantiles as qt

POINTS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def test_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(qt, "BINS", 8)
    rnd = random.Random(5)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 50, "ints": [float(rnd.randrange(20)) for _ in range(300)],
        "wide": [10.0 ** rnd.uniform(-12, 12) * rnd.choice([-1, 1]) for _ in range(200)], "normal": [rnd.gauss(0, 1) for _ in range(501)],
        "near": [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 2), 1.0, np.nextafter(1.0, 0)],
    }
    rows = [(g, "k", float(v)) for g, own in groups.items() for v in own]
    rows += [(None, "k", 1.0), ("one", None, 9.0), ("one", "k", None), ("one", "k", float("nan")), ("empty", "k", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h string, v double")
    got = {r["g"]: r["quantiles"] for r in qt.group_quantiles(df, ["g", "h"], "v", POINTS).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(own, POINTS)), rel=1e-12)


def test_infinite_values(spark):
    values = [-math.inf, -5.0, -math.inf, 0.0, 3.0, math.inf, 1e308, -1e308]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    (row,) = qt.group_quantiles(df, ["g"], "v", [0.0, 2 / 7, 3 / 7, 4 / 7, 5 / 7, 1.0]).collect()
    ordered = sorted(values)
    assert [row["quantiles"][k] for k in (0, 5)] == [-math.inf, math.inf]
    assert row["quantiles"][1:5] == pytest.approx([ordered[2], ordered[3], ordered[4], ordered[5]])


def test_no_rows(spark):
    assert qt.group_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).count() == 0
