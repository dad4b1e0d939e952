"""Quantiles, profiles, expectations and drift against numpy and by hand."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from helpers import SCHEMA, frame, hour, rows_of
from pyspark.sql import functions as F

from hourcast.operators import chunks, drift, profile
from hourcast.operators.quality import (
    Check,
    between,
    in_set,
    mean_between,
    median_between,
    not_null,
    of_type,
    quality_report,
    run_suite,
    schema_check,
    stddev_between,
    suite_from_df,
    suite_to_df,
    validate,
)
from hourcast.operators.sampling import latest, sample_n

KEYS = ["series"]


def values(seed, n, distinct):
    rng = random.Random(seed)
    return [float(rng.randint(0, distinct)) for _ in range(n)]


@pytest.mark.parametrize("n,distinct", [(1, 10), (7, 3), (500, 40), (500, 100000)])
@pytest.mark.parametrize("side", [2, 8])
def test_quantiles_match_numpy(spark, n, distinct, side):
    sample = values(n, n, distinct)
    rows = [("a", hour(i), v) for i, v in enumerate(sample)] + [("b", hour(0), 4.0), ("b", hour(1), None)]
    df = frame(spark, rows)
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for interpolate, method in ((False, "inverted_cdf"), (True, "linear")):
        out = profile.quantiles(df, "v", probs, KEYS, interpolate, side)
        got = {r["series"]: r for r in out.collect()}
        for name, p in probs.items():
            assert got["a"][name] == pytest.approx(float(np.quantile(sample, p, method=method)))
            assert got["b"][name] == 4.0


def test_slots_follow_the_distinct_values(spark, monkeypatch):
    monkeypatch.setattr(chunks, "SLOT_VALUES", 40)
    monkeypatch.setattr(chunks, "LEAST_SIDE", 2)
    largest = []
    for distinct in (100, 10_000):
        sample = [float((i * 7919) % distinct) for i in range(2 * distinct)]  # every value twice
        df = spark.createDataFrame([("a", v) for v in sample] + [("b", 1.0)], "series string, v double")
        side = chunks.measured_side(df, ["v"], KEYS)
        assert abs(side * side - distinct / 40) <= 0.2 * distinct / 40 + 2 * side + 1
        slotted = chunks.in_slots(profile.value_cells(df, "v", KEYS), KEYS, "v", ["n"], side)
        per_slot = slotted.groupBy("series", chunks.CHUNK).count()
        largest.append(per_slot.agg({"count": "max"}).first()[0])
        got = {r["series"]: r for r in profile.quantiles(df, "v", {"p": 0.1, "q": 0.75}, KEYS, interpolate=True).collect()}
        assert got["a"]["p"] == pytest.approx(np.quantile(sample, 0.1)) and got["a"]["q"] == pytest.approx(np.quantile(sample, 0.75))
        assert got["b"]["p"] == got["b"]["q"] == 1.0
    assert max(largest) <= 2 * 40  # a hundredfold of values, and no slot beyond twice its share


def test_slots_of_an_empty_table(spark):
    df = spark.createDataFrame([], "series string, v double")
    assert chunks.measured_side(df, ["v"]) == chunks.measured_side(df, ["v"], KEYS) == chunks.LEAST_SIDE
    assert profile.quantiles(df, "v", {"m": 0.5}, KEYS).count() == 0


def test_medians_of_a_suite_share_one_quantile(spark):
    rows = [(float(i % 5), i, None) for i in range(101)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "x double, y int, z double")
    suite = [
        median_between("x", 2, 2), median_between("y", 51), median_between("z"),
        not_null("x"), median_between("x", high=1),
    ]
    for side in (None, 3):
        got = [(r["observed"], r["passed"]) for r in validate(df, suite, side).collect()]
        assert got == [(2.0, True), (50.0, False), (None, False), (1.0, False), (2.0, False)]
    outliers = {r["measure"]: r["n"] for r in quality_report(df, "y", side=2).collect()}
    assert outliers == {r["measure"]: r["n"] for r in quality_report(df, "y").collect()}


def test_one_hot_value_holds_most_rows(spark):
    sample = [5.0] * 300 + values(1, 100, 50)
    df = frame(spark, [("a", hour(i), v) for i, v in enumerate(sample)])
    out = profile.quantiles(df, "v", {"p": 0.5, "q": 0.9}, interpolate=True).first()
    assert (out["p"], out["q"]) == (np.quantile(sample, 0.5), pytest.approx(np.quantile(sample, 0.9)))


def test_outliers_and_boxes(spark):
    sample = [*range(1, 12), 100.0, -50.0]
    df = frame(spark, [("a", hour(i), float(v)) for i, v in enumerate(sample)])
    row = profile.iqr_outliers(df, "v").first()
    q1, q3 = (float(np.quantile(sample, p, method="inverted_cdf")) for p in (0.25, 0.75))
    assert (row["q1"], row["q3"], row["outliers"]) == (q1, q3, 2)
    box = profile.box_stats(df, "v", KEYS).first()
    assert (box["low"], box["high"], box["whisker_low"], box["whisker_high"]) == (-50.0, 100.0, 1.0, 11.0)
    assert box["median"] == np.median(sample)


def test_counts(spark):
    rows = [("a", hour(0), None), ("a", hour(0), None), ("b", hour(1), -1.0), (None, hour(2), 3.0)]
    df = frame(spark, rows)
    nulls = profile.null_profile(df).first()
    assert (nulls["series_nulls"], nulls["v_nulls"], nulls["total_nulls"], nulls["null_pct"]) == (1, 2, 3, 75.0)
    copies = profile.duplicate_profile(df).first()
    assert (copies["rows"], copies["duplicates"], copies["duplicate_pct"]) == (4, 1, 25.0)
    assert profile.invalid_count(df, "v").first()["invalid"] == 1
    report = {r["measure"]: r["n"] for r in quality_report(df, "v").collect()}
    assert report == {"missing": 3, "invalid": 1, "duplicate": 1, "outlier": 0}


def test_extremes_take_the_first_time(spark):
    df = frame(spark, [("a", hour(i), v) for i, v in enumerate([2.0, 1.0, 1.0, 9.0, 9.0, None])])
    row = profile.extreme_times(df, KEYS, "ts", "v").first()
    assert (row["min_time"], row["max_time"], row["min_value"], row["max_value"]) == (hour(1), hour(3), 1.0, 9.0)


def test_heatmap_and_summary(spark):
    df = frame(spark, [("a", hour(0), 1.0), ("a", hour(24), 3.0), ("a", hour(5), 7.0)])
    row = profile.hour_heatmap(df, "series", "ts", "v").first()
    assert (row["h00"], row["h05"], row["h23"]) == (2.0, 7.0, None)
    stats = profile.summary_stats(df, ["v"]).first()
    assert (stats["count"], stats["min"], stats["max"]) == (3, 1.0, 7.0)


SUITE = [
    not_null("v"), of_type("v", "double"), of_type("ts", "TimestampNTZType"), in_set("series", ["a"]),
    between("v", 2, None), mean_between("v", 2, 3), median_between("v", None, 2), stddev_between("v", 5, 6),
]


def test_expectations(spark):
    df = frame(spark, [("a", hour(0), 1.0), ("a", hour(1), 2.0), ("b", hour(2), 4.0), ("a", hour(3), None)])
    out = {(r["check"], r["column"]): r for r in validate(df, SUITE).collect()}
    assert (out["not_null", "v"]["passed"], out["not_null", "v"]["n_bad"], out["not_null", "v"]["pct_bad"]) == (False, 1, 25.0)
    assert out["of_type", "v"]["passed"] and out["of_type", "ts"]["passed"]
    assert out["in_set", "series"]["n_bad"] == 1 and out["between", "v"]["n_bad"] == 1
    assert out["mean_between", "v"]["passed"] and out["median_between", "v"]["passed"]
    assert not out["stddev_between", "v"]["passed"]


def test_expectations_on_no_rows(spark):
    out = validate(frame(spark, [], SCHEMA), SUITE).collect()
    assert len(out) == len(SUITE)
    assert not [r for r in out if r["check"] == "mean_between"][0]["passed"]


def test_suite_round_trip(spark):
    restored = suite_from_df(suite_to_df(spark, SUITE))
    assert [(c.kind, c.column, c.values, c.type) for c in restored] == [
        (c.kind, c.column, c.values, c.type) for c in SUITE
    ]
    df = frame(spark, [("a", hour(0), 1.0)])
    assert rows_of(validate(df, restored), "check", "passed") == rows_of(validate(df, SUITE), "check", "passed")
    assert run_suite(df, restored, "r1").first()["run_id"] == "r1"
    assert isinstance(restored[0], Check)


def test_schema_check_sees_both_sides(spark):
    df = frame(spark, [], SCHEMA)
    assert schema_check(df, {"series": "string", "ts": "timestamp_ntz", "v": "double"}).count() == 0
    out = rows_of(schema_check(df, {"series": "int", "ts": "timestamp_ntz", "w": "double"}), "column", "problem")
    assert out == [("series", "type"), ("v", "unexpected"), ("w", "missing")]


def grouped(spark, old, new, schema="x double"):
    return frame(spark, [(v,) for v in old], schema).withColumn("g", F.lit("old")).unionByName(
        frame(spark, [(v,) for v in new], schema).withColumn("g", F.lit("new"))
    )


def test_chi2_two_by_two(spark):
    # 10 and 20 rows of value 0, 30 and 40 rows of value 1
    df = grouped(spark, [0.0] * 10 + [1.0] * 30, [0.0] * 20 + [1.0] * 40)
    row = drift.chi2_drift(df, ["x"], "g").first()
    n, a, b, c, d = 100, 10, 20, 30, 40
    expected = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert row["statistic"] == pytest.approx(expected)
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(expected / 2)))
    assert row["dof"] == 1 and row["drifted"] is False


def test_chi2_more_values_and_none(spark):
    df = grouped(spark, [0.0] * 50 + [1.0] * 30 + [2.0] * 20, [0.0] * 20 + [1.0] * 30 + [2.0] * 50)
    row = drift.chi2_drift(df, ["x"], "g").first()
    expected = 2 * (15**2 / 35 + 15**2 / 35)
    assert row["statistic"] == pytest.approx(expected) and row["dof"] == 2
    assert row["p_value"] == pytest.approx(math.exp(-expected / 2)) and row["drifted"] is True
    row = drift.chi2_drift(grouped(spark, [1.0] * 5, [1.0] * 9), ["x"], "g").first()
    assert (row["statistic"], row["dof"], row["drifted"]) == (None, None, False)


def ks(old, new):
    pooled = sorted({*old, *new})
    cdf = lambda s, x: sum(v <= x for v in s) / len(s)
    return max(abs(cdf(old, x) - cdf(new, x)) for x in pooled)


@pytest.mark.parametrize("distinct", [3, 1000])
def test_ks_matches_brute_force(spark, distinct):
    old, new = values(1, 150, distinct), [v * 1.2 for v in values(2, 90, distinct)]
    row = drift.ks_drift(grouped(spark, old, new), ["x"], "g").first()
    assert row["statistic"] == pytest.approx(ks(old, new))
    assert (row["n_old"], row["n_new"]) == (150, 90)
    swapped = drift.ks_drift(grouped(spark, new, old), ["x"], "g", side=3).first()
    assert swapped["statistic"] == pytest.approx(row["statistic"])
    scale = row["statistic"] ** 2 * 150 * 90 / 240
    p = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * scale) for j in range(1, 101))
    assert row["p_value"] == pytest.approx(min(1, max(0, p)))


def test_ks_extremes_and_rules(spark):
    same = drift.ks_drift(grouped(spark, [1.0, 2.0], [1.0, 2.0]), ["x"], "g", "pvalue").first()
    assert (same["statistic"], same["p_value"], same["drifted"]) == (0.0, 1.0, False)
    apart = drift.ks_drift(grouped(spark, [1.0] * 40, [2.0] * 40), ["x"], "g", "pvalue").first()
    assert apart["statistic"] == 1.0 and apart["drifted"] is True
    assert drift.ks_drift(grouped(spark, [1.0] * 40, [2.0] * 40), ["x"], "g").first()["effect_size"] == 1 / 40


@pytest.mark.parametrize(("n", "m"), [(1, 1), (3, 5), (6, 4), (5, 5), (1, 9)])
def test_exact_tail_counts_all_orders(n, m):
    far = []
    for places in combinations(range(n + m), n):
        i, j, worst = 0, 0, 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in places else (i, j + 1)
            worst = max(worst, abs(i * m - j * n))
        far.append(worst)
    for steps in range(n * m + 2):
        assert drift.path_share(steps, n, m) == pytest.approx(sum(w >= steps for w in far) / len(far), rel=1e-12, abs=0)


def test_exact_tail_keeps_small_values():
    assert drift.path_share(400 * 300, 400, 300) == pytest.approx(2 / math.comb(700, 300), rel=1e-9)
    # Close to the limit of large samples where both hold.
    d, n, m = 0.06, 1500, 1200
    scale = d * d * n * m / (n + m)
    limit = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * scale) for j in range(1, 101))
    assert drift.path_share(round(d * n * m), n, m) == pytest.approx(limit, rel=0.1)


def test_ks_method_is_the_callers_choice(spark):
    df = grouped(spark, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0]).withColumn("y", F.lit(1.0)).withColumn("z", F.lit(None).cast("double"))
    exact = {r["feature"]: r for r in drift.ks_drift(df, ["x", "y", "z"], "g", "pvalue", method="exact").collect()}
    assert exact["x"]["p_value"] == pytest.approx(2 / 35) and exact["x"]["drifted"] is False
    assert exact["y"]["p_value"] == 1.0 and "z" not in exact
    assert drift.ks_drift(df, ["x"], "g", "pvalue").first()["p_value"] == pytest.approx(2 * math.exp(-24 / 7), abs=1e-5)
    one_side = drift.ks_drift(df.filter("g = 'old'"), ["x"], "g", "pvalue", method="exact").first()
    assert one_side["p_value"] is None and one_side["drifted"] is False
    with pytest.raises(ValueError, match="unknown method"):
        drift.ks_drift(df, ["x"], "g", method="auto")


def test_crosstab(spark):
    df = grouped(spark, [0.0, 1.0, 1.0], [1.0])
    assert rows_of(drift.crosstab(df, "x", "g"), "x", "new", "old") == [(0.0, 0, 1), (1.0, 1, 2)]


@pytest.mark.parametrize("n", [0, 1, 37, 100, 500])
def test_sample_has_exact_size(spark, n):
    df = spark.range(100)
    out = rows_of(sample_n(df, n, 7, ["id"]))
    assert len(out) == len(set(out)) == min(n, 100)
    assert rows_of(sample_n(df.repartition(5), n, 7, ["id"])) == out
    if n == 37:
        assert rows_of(sample_n(df, n, 8, ["id"])) != out


def test_sample_within_one_cell(spark, monkeypatch):
    monkeypatch.setattr("hourcast.operators.sampling.CELLS", 2)
    assert len(rows_of(sample_n(spark.range(100), 61, 1, ["id"]))) == 61


def test_drift_groups(spark):
    df = frame(spark, [("a", hour(i), float(i)) for i in range(100)])
    out = drift.drift_groups(df, "ts", hour(79), hour(89), 1, ["series", "ts"])
    assert rows_of(out.groupBy("data_group").count()) == [("new", 10), ("old", 10)]
    assert out.filter("data_group = 'old'").agg(F.max("ts")).first()[0] <= hour(79)
    recent = drift.recent_groups(df, "ts", 1, 20, 1, ["series", "ts"])
    assert rows_of(recent.groupBy("data_group").count()) == [("new", 28), ("old", 20)]


def test_latest(spark):
    df = frame(spark, [("a", hour(0), 1.0), ("a", hour(2), 2.0), ("b", hour(1), 3.0)])
    assert rows_of(latest(df, "ts", KEYS)) == [("a", hour(2), 2.0), ("b", hour(1), 3.0)]
    assert rows_of(latest(df, "ts")) == [("a", hour(2), 2.0)]
