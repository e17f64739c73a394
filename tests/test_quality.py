import numpy as np
import pandas as pd
import pytest

from helpers import at, rows
from pulsegrid.operators import clean, keys, quality, report


def values(spark, vs):
    return spark.createDataFrame([(None if v is None else float(v),) for v in vs], "v double")


@pytest.mark.parametrize("vs,bins", [([1, 2, 2, 3, 10, None], 4), ([5, 5, 5], 3), (list(range(40)), None), ([1, 2, 2], None)])
def test_histogram_equals_numpy(spark, vs, bins):
    got = sorted(quality.histogram(values(spark, vs), "v", bins).collect())
    clean_ = [v for v in vs if v is not None]
    n, edges = np.histogram(clean_, bins=bins or min(10, len(set(clean_))))
    assert [r["n"] for r in got] == list(n)
    assert np.allclose([r["bin_lo"] for r in got], edges[:-1]) and np.allclose([r["bin_hi"] for r in got], edges[1:])


def test_histogram_of_nothing(spark):
    assert quality.histogram(values(spark, [None]), "v", 5).count() == 0


def test_describe_equals_pandas(spark):
    vs = [1.0, 4.0, 4.0, 9.5, None, -2.0]
    r, d = quality.describe(values(spark, vs), "v").first(), pd.Series(vs).describe()
    for name, p in (("n", "count"), ("mean", "mean"), ("sd", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert np.isclose(r[name], d[p])


def test_null_tables(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (None, None, 1.0), (3.0, None, None)], "a_mean double, a_last double, b_b_mean double")
    rates = quality.null_rates(df, df.columns)
    assert rows(rates, "feature", "signal", "stat", "null_count", "null_pct") == [
        ("a_last", "a", "last", 3, 100.0), ("a_mean", "a", "mean", 1, 33.33), ("b_b_mean", "b_b", "mean", 1, 33.33)]
    assert rows(quality.null_delta(rates).where("signal = 'a'"), "delta", "marker") == [(66.67, "fill would help")]
    assert rows(quality.null_by_stat(rates), "stat", "mean_null_pct") == [("last", 100.0), ("mean", 33.33)]
    assert tuple(quality.covered_rows(df, ["a_mean", "a_last"]).first())[:2] == (3, 2)
    assert quality.null_rates(df.limit(0), df.columns).first()["null_pct"] is None


def test_gate(spark):
    co = lambda pos, n: spark.createDataFrame([(int(i < pos),) for i in range(n)], "sepsis_label int")
    assert quality.gate(co(1, 20)).first()["passed"] and quality.gate(co(8, 20)).first()["passed"]
    assert not quality.gate(co(9, 20)).first()["passed"]
    quality.require_gate(co(2, 20))
    with pytest.raises(ValueError):
        quality.require_gate(co(0, 20))
    assert tuple(quality.gate(co(1, 1).limit(0)).first()) == (0, 0, 0.0, False)


def test_shares_sizes_and_ranges(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("c", 1)], "k string, x_fresh int")
    assert rows(quality.group_share(df, ["k"])) == [("a", 2, 0.5), ("b", 1, 0.25), ("c", 1, 0.25)]
    assert tuple(quality.size_stats(df, "k").select("n_groups", "min_size", "max_size", "median_size").first()) == (3, 1, 2, 1.0)
    lim = spark.createDataFrame([("x", 75.0, 80.0)], "signal string, lo double, hi double")
    assert rows(quality.range_check(df, lim)) == [("x", 75.0, True)]


def test_bounds_and_codes(spark):
    ev = spark.createDataFrame([("hr", 20.0), ("hr", 19.9), ("hr", 300.0), ("hr", None), ("other", -5.0)], "signal_name string, v double")
    b = spark.createDataFrame([("hr", 20.0, 300.0)], "signal_name string, lo double, hi double")
    once = clean.apply_bounds(ev, b, "signal_name", "v")
    assert rows(once) == [("hr", None), ("hr", 20.0), ("hr", 300.0), ("other", -5.0)]
    assert rows(clean.apply_bounds(once, b, "signal_name", "v")) == rows(once)
    assert rows(clean.bounds_report(ev, b, "signal_name", "v"), "n_dropped") == [(1,)]
    dim = clean.code_dimension(spark)
    assert dim.count() == dim.select("itemid").distinct().count() == 42
    got = clean.map_codes(spark.createDataFrame([(211,), (999,), (50912,)], "itemid int"), dim, "itemid")
    assert rows(got, "signal_name") == [("creatinine",), ("heart_rate",)]
    assert tuple(clean.incomplete_counts(ev, ["v"]).first()) == (5, 1, 1)


def test_key_sets(spark):
    mk = lambda ks: spark.createDataFrame([(k,) for k in ks], "k int")
    a, b = mk([1, 1, 2, 3]), mk([3, 4, 4])
    assert rows(keys.key_diff(a, b, ["k"])) == [(1, "only_a"), (2, "only_a"), (4, "only_b")]
    assert tuple(keys.overlap_funnel(a, b, "k").first()) == (3, 2, 1)
    assert rows(keys.common_keys(a, b, "k")) == [(3,)]
    l = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 1)], "k int, x int")
    r = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1)], "k int, y int")
    assert rows(keys.reconcile(l, r, ["k"], "x", "y")) == [(1, 0, 1), (2, 1, 0)]
    assert tuple(keys.reconcile_counts(l, r, ["k"], "x", "y").first()) == (4, 2, 1, 1)
    s = spark.createDataFrame([(g, i) for g in "ab" for i in range(9)], "g string, i int")
    assert rows(keys.sample_per_group(s, "g", ["i"], 2)) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def predictions(spark):
    return spark.createDataFrame(
        [(1, at(i / 2), at(i / 2 + 1), 2, s, s / 2, 0.1, int(s >= 0.3)) for i, s in enumerate([0.1, 0.4, 0.9])]
        + [(2, at(0), at(1), 1, 0.2, 0.8, None, 0)],
        "k int, window_start_time timestamp, window_end_time timestamp, n_events bigint, score_6h double,"
        "score_12h double, score_24h double, alert int")


def test_risk_reports(spark):
    p = predictions(spark)
    assert rows(report.entity_risk(p, "k"), "k", "max_score_6h", "n_windows", "n_alerts", "first_alert") == [
        (1, 0.9, 3, 2, at(1.5)), (2, 0.2, 1, 0, None)]
    assert rows(report.top_entities(p, "k", k=1), "k") == [(2,)]
    assert report.top_trajectory(p, "k", "max_score_6h").count() == 3
    assert rows(report.top_alerts(p, "k", k=1), "score_6h") == [(0.9,)]
    assert rows(report.alert_rate(p, "k"), "hour_bin", "alert_rate", "n_windows") == [(0, 1 / 3, 3), (1, 1.0, 1)]
    s = report.run_summary(p, "k").first()
    assert (s["n_entities"], s["n_windows"], s["n_events"], s["alerts_score_6h"], s["alerts_score_24h"]) == (2, 4, 7, 2, 0)
    assert np.isclose(s["mean_score_6h"], 0.4)
    made = report.windows_report(p, "k", "alert", ["score_24h"])
    assert rows(made["coverage"], "n_rows", "n_covered") == [(4, 3)]
    drift = quality.score_drift(p, p, "score_6h", "score_6h", 5).toPandas()
    assert (drift.n_a == drift.n_b).all() and np.isclose((drift.density_a * (drift.bin_hi - drift.bin_lo)).sum(), 1)
    imp = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.5)], "feature string, importance double")
    assert rows(report.top_importance(imp, 2), "feature", "importance_pct") == [("a", 75.0), ("b", 25.0)]
    t = spark.createDataFrame([(0, 500), (100, 2000)], "p bigint, w bigint")
    assert tuple(report.throughput(t, "p", "w").first()) == (2, 2.0, 1.0)
