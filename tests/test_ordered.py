import random

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import at, rows
from pulsegrid.operators import blocks, ordered
from pulsegrid.operators import windows as win


def test_running_sums_with_a_hot_key(spark):
    rnd = random.Random(1)
    data = [(0 if rnd.random() < 0.7 else rnd.randint(1, 30), i, rnd.randint(0, 5)) for i in range(2000)]
    data.append((None, 5000, 3))
    df = spark.createDataFrame(data, "k int, o int, v bigint").repartition(4)
    got = ordered.running_sums(df, ["k"], [F.col("o").desc()], ["v"]).collect()
    assert len(got) == len(data)
    for r in got:
        mine = [(o, v) for k, o, v in data if k == r["k"]]
        assert r["cum_v"] == sum(v for o, v in mine if o >= r["o"])
        assert r["tot_v"] == sum(v for _, v in mine)


def test_ordered_index_without_keys(spark):
    df = spark.createDataFrame([(i * 5 % 1001,) for i in range(1001)], "o int").repartition(5)
    assert all(r["o"] == r["i"] and r["n"] == 1001 for r in
               ordered.ordered_index(df, [], [F.col("o")], "i", total="n").collect())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-3, 3), st.floats(-5, 5))),
                min_size=1, max_size=60))
def test_percentiles_equal_numpy(spark, data):
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k int, v double")
    got = {r["k"]: r for r in ordered.percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 1.0}).collect()}
    for k in {k for k, _ in data}:
        mine = [v for kk, v in data if kk == k and v is not None]
        if not mine:
            assert k not in got
            continue
        for name, p in (("a", 50), ("b", 95), ("c", 100)):
            assert np.isclose(got[k][name], np.percentile(mine, p), atol=1e-9)


def test_leave_one_out_medians(spark):
    rnd = random.Random(5)
    data = [(rnd.choice("xy"), rnd.randint(0, 4), rnd.choice([None, 1.0, 2.0, rnd.random() * 9])) for _ in range(400)]
    df = spark.createDataFrame(data, "f string, fold int, v double")
    for r in ordered.lofo_medians(df, ["f"], "fold", "v", 5).collect():
        rest = [v for f, j, v in data if f == r["f"] and j != r["fold"] and v is not None]
        assert np.isclose(r["median"], np.median(rest))


def grid(spark, data):
    return spark.createDataFrame([(k, at(h), v) for k, h, v in data], "k int, t timestamp, v double")


def test_grid_fill_and_index_across_days(spark):
    data = [(1, 0, None), (1, 0.5, 1.0), (1, 30, None), (1, 100, None), (1, 101, 2.0), (1, 101.5, None),
            (2, 5, None), (2, 50, None), (3, 7, 4.0)]
    filled = blocks.grid_forward_fill(grid(spark, data), ["k"], "t", ["v"])
    want = [None, 1.0, 1.0, 1.0, 2.0, 2.0, None, None, 4.0]
    assert rows(filled, "k", "t", "v") == [(k, at(h), w) for (k, h, _), w in zip(data, want)]
    again = blocks.grid_forward_fill(filled, ["k"], "t", ["v"])
    assert rows(again) == rows(filled)
    numbered = rows(blocks.grid_index(grid(spark, data), ["k"], "t", "i", total="n", first="f"), "k", "t", "i", "n", "f")
    assert [r[2] for r in numbered] == [0, 1, 2, 3, 4, 5, 0, 1, 0]
    assert {(r[0], r[3], r[4]) for r in numbered} == {(1, 6, at(0)), (2, 2, at(5)), (3, 1, at(7))}


def test_row_order_does_not_matter(spark):
    data = [(1, i / 2, float(i) if i % 3 else None) for i in range(200)]
    a = blocks.grid_forward_fill(grid(spark, data), ["k"], "t", ["v"])
    b = blocks.grid_forward_fill(grid(spark, data[::-1]).repartition(3), ["k"], "t", ["v"])
    assert rows(a) == rows(b)


def test_last_lags_and_sequences(spark):
    data = [(1, i * 13.0, float(i)) for i in range(10)] + [(2, 0, 5.0)]
    df = grid(spark, data)
    assert rows(win.last_n(df, "k", 3, "t"), "k", "v") == [(1, 7.0), (1, 8.0), (1, 9.0), (2, 5.0)]
    lag = rows(win.lagged(df, "k", ["v"], [1, 3], "t"), "k", "v", "v_lag1", "v_lag3")
    assert lag[0] == (1, 0.0, None, None) and lag[4] == (1, 4.0, 3.0, 1.0) and lag[-1] == (2, 5.0, None, None)
    assert len(lag) == 11
    seq = win.sequence_table(df.withColumn("y", F.col("v").cast("int")), "k", ["v"], ["y"], 4, "t")
    got = {r["k"]: r for r in win.pad_sequences(seq, 5, 1, 1).collect()}
    assert got[1]["x"] == [[0.0], [6.0], [7.0], [8.0], [9.0]] and got[1]["seq_len"] == 4
    assert got[2]["mask"] == [False] * 4 + [True] and got[2]["y"] == [[0]] * 4 + [[5]]


def test_first_by(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 3, 9), (1, 3, 8), (2, 1, 1)], "k int, t int, id int")
    df = df.withColumn("t", F.timestamp_seconds("t"))
    assert rows(win.first_by(df, ["k"], "t", "id"), "k", "id") == [(1, 8), (2, 1)]
