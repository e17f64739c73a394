
from pyspark.sql import functions as F

from helpers import at, rows
from pulsegrid import schemas
from pulsegrid.functions import fixed_values as fv
from pulsegrid.operators import windows as win
from pulsegrid.plans import cohort as plan


def raw(spark):
    stays = [(1, 10, 100, at(0), at(72), 3.0, "metavision"), (2, 11, 101, at(0), at(72), 3.0, "carevue"),
             (3, 12, 102, at(5.1), at(5.2), 0.0, "carevue"), (4, 10, 100, at(200), at(210), 0.4, "metavision")]
    rx = [(100, 1, "Vancomycin HCl", "IV", at(24)), (101, 2, "aspirin", "PO", at(24)), (100, 1, "vancomycin", "TOP", at(1)),
          (102, 3, "Cefepime", None, at(5))]
    cult = [(100, "BLOOD CULTURE", None, at(30)), (101, "URINE", at(24), None), (102, "blood", at(6), None)]
    chart = [(1, 220052, at(h), 80.0) for h in range(72)] + [(1, 220277, at(1), 98.0), (2, 456, at(2.5), 60.0)]
    chart += [(1, c, at(40), v) for c, v in ((220739, 2.0), (223900, 2.0), (223901, 3.0))]
    chart += [(1, 678, at(3), 98.6), (1, 211, at(3), 999.0), (1, 777, at(3), 1.0), (1, 211, at(4), None)]
    labs = [(100, 51265, at(2), 200.0), (100, 51265, at(39.5), 90.0), (100, 50912, at(201), 1.0), (100, 50813, at(-7), 2.0)]
    return {
        "stays": spark.createDataFrame(stays, schemas.STAYS),
        "prescriptions": spark.createDataFrame(rx, schemas.PRESCRIPTIONS),
        "cultures": spark.createDataFrame(cult, schemas.CULTURES),
        "chart": spark.createDataFrame(chart, schemas.CHART_EVENTS),
        "labs": spark.createDataFrame(labs, schemas.LAB_EVENTS),
        "infusion_intervals": spark.createDataFrame([(2, 221906, at(10), at(12))], schemas.INFUSION_INTERVALS),
        "infusion_points": spark.createDataFrame([(2, 30120, at(20.5)), (2, 1, at(30))], schemas.INFUSION_POINTS),
    }


def test_cohort_from_raw_tables(spark):
    tables = raw(spark)
    assert rows(plan.suspicion_times(tables["prescriptions"], tables["cultures"], tables["stays"])) == [(1, at(24)), (3, at(5))]
    cohort, score = plan.label_cohort(**tables)
    got = {r["icustay_id"]: (r["excl_reason"], r["sepsis_label"], r["sepsis_onset_time"]) for r in cohort.collect()}
    # at hour 40 platelets fall to 90 (score 2) and the three coma parts give 7 (score 3)
    assert got == {1: ("sepsis", 1, at(40)), 2: ("no_soi", 0, None), 3: ("no_sofa_data", 0, None), 4: ("no_soi", 0, None)}
    s = {(r["icustay_id"], r["hour"]): r for r in score.collect()}
    assert len(s) == 73 + 73 + 11
    one = s[(1, at(1))]
    assert (one["s_resp"], one["s_cardio"], one["s_coag"], one["n_components"]) == (1.0, 0.0, None, 2)
    assert s[(1, at(40))]["sofa"] == 1 + 0 + 2 + 3 and s[(1, at(39))]["s_coag"] == 0.0
    assert [s[(2, at(h))]["s_cardio"] for h in (2, 3, 9, 10, 12, 13, 20, 21, 30)] == [None, 1, 1, 2, 2, 1, 2, 1, 1]


def test_stream_input_and_training_tables(spark):
    tables = raw(spark)
    cohort = tables["stays"].select("icustay_id", F.when(F.col("icustay_id") == 1, 1).otherwise(0).alias("sepsis_label"),
                                    F.when(F.col("icustay_id") == 1, F.lit(at(40))).alias("sepsis_onset_time"))
    events = plan.stream_events(tables["chart"], tables["labs"], tables["stays"], cohort)
    got = events.where("signal_name <> 'map'")
    want = {(1, "spo2", 98.0, "chartevents"), (1, "platelets", 200.0, "labevents"), (1, "platelets", 90.0, "labevents"),
            (4, "creatinine", 1.0, "labevents"), (1, "lactate", 2.0, "labevents"), (1, "temperature", 37.0, "chartevents")}
    assert {(r["icustay_id"], r["signal_name"], round(r["valuenum"], 9), r["source_table"]) for r in got.collect()} == want
    windows = win.sliding_features(events, "icustay_id", "charttime", "signal_name", "valuenum")
    assert sum(c.endswith(tuple("_" + t for t in fv.STATS)) for c in windows.columns) == 72
    folds, seq, tree = plan.training_tables(windows, cohort)
    assert folds.count() == 4 and seq.count() == tree.count() == windows.count()
    assert seq.where(" or ".join(f"{s}_last is null" for s in fv.SIGNALS)).count() == 0
    assert len(tree.columns) == 3 + 3 + 48 and len(seq.columns) == 3 + 3 + 24
    positive = seq.where("label_6h = 1").agg(F.min("window_end_time"), F.max("window_end_time")).first()
    assert positive[0] >= at(34) and positive[1] < at(40)


