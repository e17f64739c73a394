import pytest
from pyspark.sql import functions as F

from helpers import at, rows
from pulsegrid.functions import scalar as fx


def one(spark, col, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("fn,cases", [
    (fx.spo2_ratio, {97: 400, 96.9: 300, 95: 300, 90: 200, 80: 100, 79.9: 50}),
    (fx.score_respiratory, {400.1: 0, 400: 1, 300: 2, 200: 3, 100: 4}),
    (fx.score_platelets, {151: 0, 150: 1, 100: 2, 50: 3, 20: 4}),
    (fx.score_bilirubin, {1.1: 0, 1.2: 1, 2: 2, 6: 3, 12: 4}),
    (fx.score_creatinine, {1.1: 0, 1.2: 1, 2: 2, 3.5: 3, 5: 4}),
    (fx.score_coma, {15: 0, 14: 1, 13: 1, 10: 2, 6: 3, 5: 4}),
])
def test_bands(spark, fn, cases):
    df = spark.createDataFrame([(float(v), float(e)) for v, e in cases.items()] + [(None, None)],
                               "v double, e double")
    for r in df.select("e", fn("v").alias("g")).collect():
        assert r["g"] == r["e"]


def test_pressure_score(spark):
    df = spark.createDataFrame(
        [(80.0, True), (70.0, False), (69.0, False), (None, False), (None, True), (70.0, None)],
        "p double, f boolean")
    assert [r[0] for r in df.select(fx.score_pressure("p", "f")).collect()] == [2, 0, 1, None, 2, 0]


def test_text_filters(spark):
    df = spark.createDataFrame([("IV Vancomycin",), ("aspirin",), (None,), ("a.b",)], "t string")
    assert [r[0] for r in df.select(fx.match_any("t", ["vancomycin", "a.b"])).collect()] == [
        True, False, False, True]
    assert [r[0] for r in df.select(fx.match_any("t", ["a.p"])).collect()] == [False] * 4
    df = spark.createDataFrame([(" iv ",), ("TOP",), (None,)], "r string")
    assert [r[0] for r in df.select(fx.allow_or_null("r", ["IV"])).collect()] == [True, False, True]


def test_parse_times_is_lenient(spark):
    df = spark.createDataFrame([("2024-01-01 01:02:03",), ("nope",), (None,)], "t string")
    got = [r[0] for r in fx.parse_times(df, ["t", "missing"]).collect()]
    assert got == [at(1 + 2 / 60 + 3 / 3600), None, None]


def test_units_sums_and_ratios(spark):
    df = spark.createDataFrame(
        [(678, 212.0, None, None), (676, 37.0, 1.0, None)], "c int, v double, a double, b double")
    assert [r[0] for r in df.select(fx.convert_units("v", "c")).collect()] == [100.0, 37.0]
    got = df.select(fx.row_sum(["a", "b"]), fx.row_count(["a", "b"]), fx.ensemble_mean(["a", "b"])).collect()
    assert [tuple(r) for r in got] == [(0.0, 0, None), (1.0, 1, 1.0)]
    df = spark.createDataFrame([(80.0, 0.4), (80.0, 0.0), (80.0, None), (None, 0.4)], "n double, d double")
    assert [r[0] for r in df.select(fx.ratio_or("n", "d", F.lit(-1.0))).collect()] == [200.0, -1, -1, -1]
    df = spark.createDataFrame([(0.0,), (50.0,), (100.0,), (101.0,), (None,)], "v double")
    assert [r[0] for r in df.select(fx.valid_fraction("v")).collect()] == [None, 0.5, 1.0, None, None]


@pytest.mark.parametrize("onset,positive,expected", [
    (at(10), 1, 0), (at(10.01), 1, 1), (at(16), 1, 1), (at(16.01), 1, 0), (at(12), 0, 0),
    (None, 1, 0), (at(12), None, 0),
])
def test_horizon_label_edges(spark, onset, positive, expected):
    got = one(spark, fx.horizon_label("e", "o", 6, "p"), e=("timestamp", at(10)),
              o=("timestamp", onset), p=("int", positive))
    assert got == expected


@pytest.mark.parametrize("gap_s,expected", [
    (0, "A"), (21600, "A"), (59, "B"), (-59, "B"), (21659, "B"), (60, "E"), (300, "E"), (None, "D"),
])
def test_gap_category(spark, gap_s, expected):
    onset = None if gap_s is None else at(10 + gap_s / 3600)
    assert one(spark, fx.gap_category("e", "o"), e=("timestamp", at(10)), o=("timestamp", onset)) == expected


def test_small_helpers(spark):
    df = spark.createDataFrame([("heart_rate_last", 97, at(1.5))], "f string, i int, t timestamp")
    signal, stat = fx.split_feature("f")
    r = df.select(signal, stat, fx.hour_bin("i"), fx.on_boundary("t"), fx.ceil_hour("t")).first()
    assert tuple(r) == ("heart_rate", "last", 48, True, at(2))
    assert one(spark, fx.ceil_hour("t"), t=("timestamp", at(2))) == at(2)
    assert fx.drop_suffix(spark.createDataFrame([(1, 2, 3)], ["a_mean", "a_slope", "a_stddev"])).columns == ["a_mean"]
    assert fx.ensure_columns(df, ["f", "new"]).columns == ["f", "i", "t", "new"]
    df = spark.createDataFrame([(0.3,), (0.29,), (None,)], "s double")
    assert [r[0] for r in df.select(fx.alert_flag("s")).collect()] == [1, 0, 0]


def test_ntz_round_trip(spark):
    df = spark.createDataFrame([(at(1), 1)], "t timestamp, k int")
    plain = fx.to_utc_ntz(df)
    assert dict(plain.dtypes)["t"] == "timestamp_ntz"
    assert rows(fx.from_ntz(plain)) == rows(df)
