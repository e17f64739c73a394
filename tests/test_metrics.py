import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import at, rows
from pulsegrid.operators import metrics as mt


def pairs_auroc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    win = tot = 0.0
    for i in np.flatnonzero(y == 1):
        for j in np.flatnonzero(y == 0):
            win += w[i] * w[j] * (1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0)
            tot += w[i] * w[j]
    return win / tot


def step_ap(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    out, total = 0.0, w[y == 1].sum()
    for t in sorted(set(s), reverse=True):
        here, over = (s == t) & (y == 1), s >= t
        out += w[here].sum() / total * (w[over & (y == 1)].sum() / max(w[over].sum(), 1e-300))
    return out


def data(n=300, seed=0):
    rnd = np.random.default_rng(seed)
    y = (rnd.random(n) < 0.3).astype(int)
    return y, np.round(rnd.random(n) * 0.7 + y * 0.2, 2)


def frame(spark, y, s, group="g"):
    return spark.createDataFrame([(group, int(a), float(b)) for a, b in zip(y, s)], "g string, y int, s double")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40))
def test_ranking_metrics_against_brute_force(spark, items):
    y, s = np.array([a for a, _ in items]), np.array([b / 6 for _, b in items])
    got = mt.metric_table(frame(spark, y, s), ["g"], "y", "s").collect()
    if y.sum() == 0:
        assert not got
        return
    r = got[0]
    assert np.isclose(r["average_precision"], step_ap(y, s))
    if y.sum() == len(y):
        assert r["auroc"] is None
        return
    assert np.isclose(r["auroc"], pairs_auroc(y, s))
    for spec, name in ((0.9, "sens_at_90"), (0.95, "sens_at_95")):
        ok = [np.mean(s[y == 1] >= t) for t in set(s) if np.mean(s[y == 0] >= t) <= 1 - spec + 1e-12]
        assert np.isclose(r[name], max(ok, default=0.0))


def test_auroc_ignores_monotone_maps_and_groups_stay_apart(spark):
    y, s = data()
    df = frame(spark, y, s).unionAll(frame(spark, 1 - y, s, "h"))
    a = {r["g"]: r["auroc"] for r in mt.auroc(df, ["g"], "y", "s").collect()}
    b = {r["g"]: r["auroc"] for r in mt.auroc(df.withColumn("s", F.exp("s") * 3 - 1), ["g"], "y", "s").collect()}
    assert np.isclose(a["g"], b["g"]) and np.isclose(a["g"] + a["h"], 1.0)


def test_curves_end_at_one(spark):
    y, s = data()
    roc = mt.roc_points(frame(spark, y, s), ["g"], "y", "s").orderBy("threshold").first()
    assert (roc["fpr"], roc["tpr"]) == (1.0, 1.0)
    pr = mt.pr_points(frame(spark, y, s), ["g"], "y", "s").orderBy("threshold").first()
    assert pr["recall"] == 1.0 and np.isclose(pr["precision"], y.mean())


def test_bootstrap_replicas_against_the_weights_themselves(spark):
    """Recompute each replica from its row weights, over scores split in many ranges."""
    y, s = data(400, 3)
    s[:150] = 0.5  # one score holds a third of the rows
    df = frame(spark, y, s)
    draws, seed = 8, 11
    got = {r["replica"]: r for r in mt.bootstrap_replicas(df, ["g"], "y", "s", draws, seed).collect()}
    counts = mt.score_counts(df, ["g"], "y", "s").withColumn("_id", F.xxhash64("g", "score")).toPandas()
    ids = counts["_id"].to_numpy(np.int64)
    wp = mt._weights(ids, counts["pos"].to_numpy(), draws, 2 * seed)
    wn = mt._weights(ids, counts["neg"].to_numpy(), draws, 2 * seed + 1)
    labels = np.r_[np.ones(len(ids)), np.zeros(len(ids))].astype(int)
    scores = np.r_[counts["score"], counts["score"]]
    for b in range(draws):
        w = np.r_[wp[:, b], wn[:, b]]
        assert np.isclose(got[b]["auroc"], pairs_auroc(labels, scores, w))
        assert np.isclose(got[b]["average_precision"], step_ap(labels, scores, w))


def test_bootstrap_interval_surrounds_the_metric(spark):
    y, s = data(500, 5)
    df = frame(spark, y, s)
    exact = mt.auroc(df, ["g"], "y", "s").first()["auroc"]
    a = mt.bootstrap_ci(df, ["g"], "y", "s", 200).first()
    b = mt.bootstrap_ci(df.repartition(3), ["g"], "y", "s", 200).first()
    assert a["n_replicas"] == 200
    assert a["auroc_lo"] < exact < a["auroc_hi"] and abs(a["auroc_mean"] - exact) < 0.01
    assert all(np.isclose(x, z) for x, z in zip(a[1:], b[1:]))


def test_poisson_weights_have_the_right_moments():
    ids, n = np.arange(4000), np.ones(4000, dtype=int)
    w = mt._weights(ids, n, 50, 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    w = mt._weights(ids[:200], n[:200] * 40, 100, 3)
    assert abs(w.mean() - 40) < 0.3 and abs(w.var() - 40) < 2


def test_lead_times(spark):
    co = spark.createDataFrame([(1, 1, at(10)), (2, 1, at(10)), (3, 0, at(10)), (4, 1, at(10)), (5, 1, None)],
                               "k int, sepsis_label int, sepsis_onset_time timestamp")
    sc = spark.createDataFrame(
        [(1, at(2), 0.9), (1, at(1), 0.2), (1, at(5), 0.8), (2, at(10), 0.5), (3, at(1), 0.9), (4, at(10.5), 0.9),
         (5, at(1), 0.9)], "k int, window_end_time timestamp, s double")
    leads = mt.lead_times(sc, co, "k", "s", 0.5)
    assert rows(leads, "k", "lead_hours") == [(1, 8.0), (2, 0.0)]
    r = mt.lead_summary(leads, co).first()
    assert (r["n_detected"], r["n_positive"], r["median_hours"], r["share_over_4h"], r["share_over_8h"]) == (2, 4, 4.0, 0.5, 0.0)
    assert np.isclose(r["p80_hours"], 6.4)


def test_ensemble_skips_nulls(spark):
    a = spark.createDataFrame([(1, 1, 0.2), (2, 0, None)], "k int, y int, a_y double")
    b = spark.createDataFrame([(1, 0.4), (2, 0.6), (3, 0.1)], "k int, b_y double")
    assert rows(mt.ensemble(a, b, ["k"], "a", "b", ["y"]), "k", "ens_y") == [(1, 0.30000000000000004), (2, 0.6)]


def test_entity_weights_are_poisson_and_repeat(spark):
    weights = np.stack([mt.entity_weights(str(i), 1001, 3) for i in range(300)])
    assert weights.shape == (300, 1001) and (mt.entity_weights("7", 1001, 3) == weights[7]).all()
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02 and abs(np.corrcoef(weights[0], weights[1])[0, 1]) < 0.1
    db = duckdb.connect()
    word = db.sql("SELECT CAST('0x' || substr(md5('3:' || (6 // 4) || ':' || 7), 1 + 8 * (6 % 4), 8) AS BIGINT)").fetchall()[0][0]
    assert (mt.POISSON_BOUNDS <= word).sum() == weights[7][6]


def test_bootstrap_of_entities(spark):
    """Every replica equals the metric of the rows repeated as often as their entity is drawn."""
    rnd, draws, seed = random.Random(6), 30, 5
    data = [("g" if i % 3 else "h", e, int(rnd.random() < 0.3 + ((e or 0) % 2) * 0.3), rnd.choice([0.1, 0.2, 0.5, 0.9, rnd.random()]))
            for i in range(900) for e in [rnd.choice([0, 0, 0, *range(25), None])]]
    data += [("one class", 1, 1, 0.4), ("g", 3, None, 0.5), ("g", 3, 1, None)]
    df = spark.createDataFrame(data, "g string, e int, y int, s double")
    got = {(r["g"], r["replica"]): r for r in mt.bootstrap_replicas(df, ["g"], "y", "s", draws, seed, "e").collect()}
    weights = {e: mt.entity_weights("" if e is None else str(e), draws, seed) for e in {e for _, e, _, _ in data}}
    for g in ("g", "h"):
        rows = [(y, s, weights[e]) for gg, e, y, s in data if gg == g and y is not None and s is not None]
        for r in range(draws):
            flat = [(y, s) for y, s, w in rows for _ in range(int(w[r]))]
            pos, neg = [s for y, s in flat if y], [s for y, s in flat if not y]
            wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
            assert got[g, r]["auroc"] == pytest.approx(wins / (len(pos) * len(neg)))
            ap = sum(sum(y for y, s in flat if s >= t) / sum(s >= t for _, s in flat) for t in pos) / len(pos)
            assert got[g, r]["average_precision"] == pytest.approx(ap)
    assert not any(g == "one class" for g, _ in got) and len(got) == 2 * draws


def test_ties_over_batches():
    """A score shared by more rows than a batch holds is one score."""
    pdf = pd.DataFrame({"score": [0.9] * 5 + [0.5] * 2 + [0.1] * 9, "_entity": [str(i) for i in range(16)],
                        "pos": [1, 0] * 8, "neg": [0, 1] * 8})
    zero = np.zeros(1_000_000)
    small = [v[:1000] for v in mt._walk_entities(pdf, 1_000_000, 1, zero, zero)]
    whole = mt._walk_entities(pdf, 1000, 1, zero[:1000], zero[:1000])
    assert all(np.allclose(a, b) for a, b in zip(small, whole))


def test_one_score_of_all_entities_is_spread(spark, monkeypatch):
    """Entities that share a score are weighed in several tasks, each entity once; by ranges it is the same."""
    rnd = random.Random(2)
    data = [("g", i % 400, int(rnd.random() < 0.4), 0.5 if i % 5 else round(rnd.random(), 1)) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, e int, y int, s double")
    monkeypatch.setattr(mt, "ENTITY_ROWS", 100)
    replicas = mt.bootstrap_replicas(df, ["g"], "y", "s", 20, 5, "e")
    dealt = [n for n in replicas._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in n]
    assert any("_entity" in n for n in dealt)
    got = {r["replica"]: r for r in replicas.collect()}
    monkeypatch.setattr(mt, "SCORES_AT_ONCE", 0)
    ranges = {r["replica"]: r for r in mt.bootstrap_replicas(df, ["g"], "y", "s", 20, 5, "e").collect()}
    assert got.keys() == ranges.keys() and len(got) == 20
    for r, row in ranges.items():
        assert got[r]["auroc"] == pytest.approx(row["auroc"]) and got[r]["average_precision"] == pytest.approx(row["average_precision"])
