"""Exact medians by counting against sorting."""

import math
import random
import statistics

from granary.functions.selection import exact_medians


def test_medians_against_sorting(spark):
    r = random.Random(2)
    groups = {
        ("a", 1): [r.gauss(0, 1) for _ in range(501)], ("a", None): [r.uniform(-1e300, 1e300) for _ in range(40)], (None, 1): [0.5] * 30 + [0.25], ("b", 1): [7.0], ("b", 2): [1.0, 2.0],
        ("c", 1): [0.0, -0.0, 5e-324, -5e-324], ("c", 2): [float("inf"), -float("inf"), 3.0], ("d", 1): [1.0 + i * 2**-52 for i in range(10)], ("e", 1): [None, None],
    }
    rows = [(*g, v) for g, values in groups.items() for v in [*values, None]]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "x string, y int, v double")
    got = {(m.x, m.y): m["median"] for m in exact_medians(df, ["x", "y"], "v").collect()}
    assert got == {g: statistics.median(v for v in values if v is not None) for g, values in groups.items() if any(v is not None for v in values)}
    assert [m["median"] for m in exact_medians(df, [], "v").collect()] == [statistics.median(v for *_, v in rows if v is not None)]


def test_medians_with_nan_and_of_nothing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0), ("b", float("nan")), ("b", -float("nan")), ("b", 1.0)], "x string, v double")
    got = {m.x: m["median"] for m in exact_medians(df, ["x"], "v").collect()}
    assert got["a"] == 2.0 and math.isnan(got["b"])  # NaN is larger than any number
    assert exact_medians(df.limit(0), ["x"], "v").collect() == []
