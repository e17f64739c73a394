import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helpers import at, rows
from pulsegrid.operators import labels as lab
from pulsegrid.operators import windows as win

SIG = ["a", "b", "absent"]


def brute(events, signals):
    pdf = pd.DataFrame(events, columns=["k", "t", "s", "v", "id"])
    pdf["slot"] = pdf.t.dt.floor("30min")
    both = pd.concat([pdf.assign(ws=pdf.slot), pdf.assign(ws=pdf.slot - pd.Timedelta("30min"))])
    out = {}
    for (k, ws), g in both.groupby(["k", "ws"]):
        row = {"n_events": len(g)}
        for s in signals:
            m = g[(g.s == s) & g.v.notna()].sort_values(["t", "id"])
            row[f"{s}_mean"] = m.v.mean() if len(m) else None
            row[f"{s}_stddev"] = m.v.std() if len(m) > 1 else None
            row[f"{s}_min"] = m.v.min() if len(m) else None
            row[f"{s}_max"] = m.v.max() if len(m) else None
            row[f"{s}_last"] = m.v.iloc[-1] if len(m) else None
            sec = m.t.astype("int64") // 10**6 if str(m.t.dtype).endswith("[us]") else m.t.astype("int64") // 10**9
            x = (sec - sec.min()).astype(float)
            row[f"{s}_slope"] = np.polyfit(x, m.v, 1)[0] if x.nunique() > 1 else None
        out[(k, ws.to_pydatetime())] = row
    return out


def events(seed=0):
    rnd = random.Random(seed)
    ev = [(rnd.choice([1, 1, 1, 2]), at(rnd.randint(0, 400) / 60), rnd.choice(["a", "b", "other"]),
           rnd.choice([None, 1.5, rnd.random() * 50])) for _ in range(150)]
    ev += [(3, at(0.5), "a", 4.0), (4, at(1), "a", 1.0), (4, at(1), "a", 2.0), (5, at(1), "other", 7.0),
           (6, at(1), "b", None)]
    return [(*e, i) for i, e in enumerate(ev)]


def test_sliding_features_against_brute_force(spark):
    ev = events()
    df = spark.createDataFrame(ev, "k int, t timestamp, s string, v double, id bigint")
    got = win.sliding_features(df, "k", "t", "s", "v", SIG, tie="id").collect()
    want = brute(ev, SIG)
    assert len(got) == len(want)
    for r in got:
        w = want[(r["k"], r["window_start_time"])]
        for c, v in w.items():
            assert (r[c] is None) == (v is None), c
            assert v is None or np.isclose(r[c], v, atol=1e-9), c


def test_an_event_on_the_edge_falls_in_two_windows(spark):
    df = spark.createDataFrame([(3, at(0.5), "a", 4.0, 1)], "k int, t timestamp, s string, v double, id bigint")
    got = rows(win.sliding_features(df, "k", "t", "s", "v", SIG, tie="id"), "window_start_time", "window_end_time", "a_last")
    assert got == [(at(0), at(1), 4.0), (at(0.5), at(1.5), 4.0)]


def test_both_forms_of_the_pivot_agree(spark):
    df = spark.createDataFrame(events(4), "k int, t timestamp, s string, v double, id bigint")
    wide = df.groupBy("k", F.window("t", "1 hour", "30 minutes")).agg(*win.signal_stats(SIG, "s", "v", "t", "id", "k"))
    cols = [f"{s}_{t}" for s in SIG for t in ("mean", "stddev", "min", "max", "last", "slope")]
    wide = wide.select("k", F.col("window.start").alias("window_start_time"), *cols)
    long = win.sliding_features(df, "k", "t", "s", "v", SIG, tie="id").select("k", "window_start_time", *cols)
    r = lambda d: rows(d.select("k", "window_start_time", *[F.round(c, 9).alias(c) for c in cols]))
    assert r(wide) == r(long)


def test_last_without_a_tie_column_is_repeatable(spark):
    data = [(1, at(1), "a", float(v)) for v in range(20)]
    mk = lambda d: spark.createDataFrame(d, "k int, t timestamp, s string, v double").repartition(4)
    one = lambda d: rows(win.sliding_features(mk(d), "k", "t", "s", "v", ["a"]), "a_last")
    assert one(data) == one(data[::-1])


def test_temporal_features(spark):
    df = spark.createDataFrame([(1, at(0)), (1, at(30)), (1, at(31)), (2, at(9))], "k int, window_start_time timestamp")
    assert rows(win.temporal_features(df, "k"), "k", "window_idx", "window_idx_norm", "hours_in_icu") == [
        (1, 0, 0.0, 0.0), (1, 1, 0.5, 30.0), (1, 2, 1.0, 31.0), (2, 0, 0.0, 0.0)]


def test_latency_of_both_forms(spark):
    df = spark.createDataFrame([(1, at(1), "a", 1.0, 10), (1, at(1.1), "x", 1.0, 20)], "k int, t timestamp, s string, v double, l bigint")
    r = win.sliding_features(df, "k", "t", "s", "v", ["a"], latency="l").first()
    assert (r["avg_latency_ms"], r["min_latency_ms"], r["max_latency_ms"], r["n_events"]) == (15.0, 10, 20, 2)


# --- onset ---------------------------------------------------------------------------

def test_baseline_and_rise(spark):
    series = spark.createDataFrame(
        [(1, at(h), s) for h, s in [(0, 5.0), (60, 1.0), (70, 2.0), (80, 3.0), (90, 9.0)]]
        + [(2, at(0), 1.0), (2, at(1), 4.0)] + [(3, at(0), 1.0), (3, at(1), 2.5)] + [(4, at(0), 1.0)],
        "k int, h timestamp, s double")
    ents = spark.createDataFrame([(i, at(0)) for i in (1, 2, 3, 4, 5)], "k int, start timestamp")
    refs = spark.createDataFrame([(1, at(100)), (2, at(200)), (3, at(1)), (5, at(1))], "k int, ref timestamp")
    both = refs.join(ents, "k")
    # 1: first hour at/after 52 is 60; 2: all before 152, so the last value; 3: from the start
    assert rows(lab.baseline_value(series, both, "k", "h", "s", "start", "ref")) == [(1, 1.0), (2, 4.0), (3, 1.0)]
    got = {r["k"]: (r["excl_reason"], r["sepsis_label"], r["sepsis_onset_time"]) for r in
           lab.label_entities(ents, series, refs, "k", "h", "s", "start", "ref").collect()}
    assert got == {1: ("sepsis", 1, at(80)), 2: ("criteria_not_met", 0, None),
                   3: ("criteria_not_met", 0, None), 4: ("no_soi", 0, None), 5: ("no_sofa_data", 0, None)}


# --- folds -----------------------------------------------------------------------------

def cohort(spark, n=103):
    return spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(n)], "k bigint, y int")


def test_folds_are_balanced_and_stable(spark):
    a = lab.stratified_folds(cohort(spark), "k", "y")
    b = lab.stratified_folds(cohort(spark).repartition(3), "k", "y")
    assert rows(a) == rows(b)
    per = pd.DataFrame(rows(a, "y", "fold"), columns=["y", "fold"]).groupby(["y", "fold"]).size()
    assert a.count() == 103 and a.select("k").distinct().count() == 103
    for y in (0, 1):
        assert per[y].max() - per[y].min() <= 1
    other = lab.stratified_folds(cohort(spark), "k", "y", seed=7)
    assert rows(a) != rows(other)


def lofo_frame(spark):
    rnd = random.Random(2)
    data = [(k, at(i), rnd.choice([None, rnd.random() * 10]), None if k < 60 else 1e6 + rnd.random())
            for k in range(103) for i in range(rnd.randint(1, 4))]
    return data, spark.createDataFrame(data, "k bigint, window_start_time timestamp, p_last double, q_last double")


def test_leave_one_fold_out_statistics(spark):
    data, df = lofo_frame(spark)
    folds = lab.stratified_folds(cohort(spark), "k", "y").checkpoint()
    fold = {r["k"]: r["fold"] for r in folds.collect()}
    cols = ["p_last", "q_last"]
    med = lab.lofo_median(df, folds, "k", cols)
    stored = {(r["feature"], r["fold"]): r["median"] for r in med.collect()}
    moments = {(r["feature"], r["fold"]): r for r in lab.lofo_moments(df, folds, "k", cols).collect()}
    for j in range(5):
        for c, pos in (("p_last", 2), ("q_last", 3)):
            rest = [d[pos] for d in data if fold[d[0]] != j and d[pos] is not None]
            assert np.isclose(stored[(c, j)], np.median(rest))
            assert np.isclose(moments[(c, j)]["mean"], np.mean(rest), rtol=1e-12)
            assert np.isclose(moments[(c, j)]["sd"], np.std(rest, ddof=1), rtol=1e-9)
    assert tuple(lab.leakage_check(df, folds, "k", cols, med).first()) == (10, 0)
    wrong = med.withColumn("median", F.col("median") + F.when(F.col("fold") == 1, 0.1).otherwise(0.0))
    assert tuple(lab.leakage_check(df, folds, "k", cols, wrong).first()) == (10, 2)
    filled = lab.fill_and_impute(df, folds, "k", cols).collect()
    assert len(filled) == len(data) and all(r["p_last"] is not None for r in filled)


def test_absent_signal_falls_back_to_zero(spark):
    df = spark.createDataFrame([(i, at(0), None) for i in range(103)], "k bigint, window_start_time timestamp, z_last double")
    folds = lab.stratified_folds(cohort(spark), "k", "y")
    assert rows(lab.lofo_median(df, folds, "k", ["z_last"]), "median") == [(0.0,)] * 5


def test_fold_table_has_a_total(spark):
    folds = lab.stratified_folds(cohort(spark), "k", "y").checkpoint()
    windows = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(103) for _ in range(2)], "k bigint, l int")
    table = lab.fold_table(cohort(spark), windows, folds, "k", "y", "l").toPandas()
    total = table[table.is_total == 1].iloc[0]
    parts = table[table.is_total == 0]
    for c in ("n_entities", "n_positive", "n_negative", "n_windows", "n_positive_windows"):
        assert parts[c].sum() == total[c]
    assert (total.n_entities, total.n_windows, total.n_positive_windows) == (103, 206, 22)


def test_last_takes_ids_of_all_64_bits(spark):
    """Time decides before the id does, whatever its size or sign."""
    ends = [-2**63, -9 * 10**17, -1, 0, 9 * 10**17, 7 * 10**18, 2**63 - 1]
    data = [(k, t, i, float(n)) for k, early in enumerate(ends)
            for n, (t, i) in enumerate([(at(1), early), (at(1) + timedelta(microseconds=1), -2**63)])]
    data += [(100, at(1), i, float(n)) for n, i in enumerate(ends)]
    data += [(200, datetime(1, 1, 2), 2**63 - 1, 0.0), (200, datetime(9999, 12, 30), -2**63, 1.0)]
    df = spark.createDataFrame(data, "k int, t timestamp, id bigint, v double")
    got = {r["k"]: r["v"] for r in df.groupBy("k").agg(F.max_by("v", win.last_order("t", "id", [])).alias("v")).collect()}
    assert got == {**{k: 1.0 for k in range(len(ends))}, 100: float(len(ends) - 1), 200: 1.0}
    first = {r["k"]: r["v"] for r in win.first_by(df, ["k"], "t", "id").collect()}
    assert first == {**{k: 0.0 for k in range(len(ends))}, 100: 0.0, 200: 0.0}


def test_lags_reach_over_blocks(spark):
    """Rows at the border of a block are seen from the next one; nothing else is copied."""
    df = spark.createDataFrame([(k, at(i * 13), None if i % 5 == 0 else float(i)) for k in (1, None) for i in range(23)], "k bigint, window_start_time timestamp, x double")
    for lags in ([1, 3], [4], [-2, 0, 2], [9]):
        got = {(r["k"], r["window_start_time"]): r for r in win.lagged(df, "k", ["x"], lags, block=4).collect()}
        assert len(got) == 46
        for k in (1, None):
            xs = [None if i % 5 == 0 else float(i) for i in range(23)]
            for i in range(23):
                r = got[k, at(i * 13)]
                assert r["x"] == xs[i] and [r[f"x_lag{n}"] for n in lags] == [xs[i - n] if 0 <= i - n < 23 else None for n in lags]
