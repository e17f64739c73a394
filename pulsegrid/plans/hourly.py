"""The hourly composite score over an entity's stay."""

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions import scalar as fx
from pulsegrid.operators.clean import keep_codes
from pulsegrid.operators.timejoin import (
    asof_fill, flag_hours, hourly_spine, hours_covered, hours_marked, sum_parts,
)

PARTS = ["s_resp", "s_coag", "s_liver", "s_cardio", "s_cns", "s_renal"]
ROLES = ["spo2", "map", "fio2", "coma_total", "coma_sum", "pao2", "platelets", "bilirubin",
         "creatinine"]


def score_columns(df: DataFrame) -> DataFrame:
    """Six sub-scores, their null-skipping sum and how many are known."""
    ratio = fx.ratio_or("pao2", fx.valid_fraction("fio2"), fx.spo2_ratio("spo2"))
    coma = F.coalesce("coma_total", "coma_sum")
    scored = df.withColumns({
        "s_resp": fx.score_respiratory(ratio),
        "s_coag": fx.score_platelets("platelets"),
        "s_liver": fx.score_bilirubin("bilirubin"),
        "s_cardio": fx.score_pressure("map", "pressor"),
        "s_cns": fx.score_coma(coma),
        "s_renal": fx.score_creatinine("creatinine"),
    })
    return scored.withColumns({
        "sofa": fx.row_sum(PARTS), "n_components": fx.row_count(PARTS),
    })


def hourly_score(stays: DataFrame, readings: DataFrame, infusion_intervals: DataFrame,
                 infusion_points: DataFrame, key: str, ts: str = "charttime",
                 tie: str | None = None) -> DataFrame:
    """One row per entity and whole hour of its stay.

    `readings` is long: key, ts, role, part, value. Each hour sees the last reading
    of every role at or before it, from the admission on; the three coma parts count only when charted
    together.
    """
    grid = hourly_spine(stays, key, "intime", "outtime")
    tie_cols = [tie] if tie else []
    single = readings.where(F.col("role") != "coma_part").select(key, ts, "role", "value", *tie_cols)
    summed = sum_parts(readings.where(F.col("role") == "coma_part"), key, ts, "part", "value")
    summed = summed.select(key, ts, F.lit("coma_sum").alias("role"), "value")
    points = single.unionByName(summed, allowMissingColumns=True)
    if tie:
        points = points.withColumn(tie, F.coalesce(tie, F.lit(0)))
    admitted = stays.select(key, F.col("intime").alias("since"))
    filled = asof_fill(grid, points, key, ts, "role", "value", ROLES, tie, admitted)
    # both kinds of infusion record mark hours, so one join flags the grid
    pressor = hours_covered(infusion_intervals, key, "starttime", "endtime").unionByName(
        hours_marked(infusion_points, key, ts)
    ).distinct()
    flagged = flag_hours(filled, pressor, key, "pressor")
    return score_columns(flagged).select(key, "hour", "sofa", "n_components", *PARTS)


def readings_from_codes(chart: DataFrame, labs: DataFrame, key: str) -> DataFrame:
    """Item-coded chart and lab rows (labs already carrying the key) as roles."""
    role = F.lit(None).cast("string")
    for name, codes in fv.SCORE_CHART_CODES + fv.SCORE_LAB_CODES:
        role = F.when(F.col("itemid").isin(codes), F.lit(name)).otherwise(role)
    known = [c for _, codes in fv.SCORE_CHART_CODES for c in codes]
    lab_codes = [c for _, codes in fv.SCORE_LAB_CODES for c in codes]
    cols = [key, "itemid", "charttime", "valuenum"]
    rows = keep_codes(chart, "itemid", known).select(*cols).unionByName(
        keep_codes(labs, "itemid", lab_codes).select(*cols)
    )
    return rows.na.drop(subset=[key, "valuenum"]).select(
        key, "charttime", role.alias("role"), F.col("itemid").alias("part"),
        F.col("valuenum").alias("value"),
    )
