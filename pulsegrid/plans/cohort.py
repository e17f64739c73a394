"""Whole jobs: cohort labelling, stream input and training tables."""

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions.scalar import allow_or_null, convert_units, drop_suffix, match_any
from pulsegrid.operators.clean import (
    apply_bounds, bounds_dimension, code_dimension, drop_incomplete, keep_codes, keep_ids,
    map_codes,
)
from pulsegrid.operators.labels import (
    horizon_labels, label_entities, sequence_features, stratified_folds, tree_features,
)
from pulsegrid.operators.timejoin import assign_interval, pair_events
from pulsegrid.operators.windows import first_by
from pulsegrid.plans.hourly import hourly_score, readings_from_codes
from pulsegrid.session import stored


def first_stays(stays: DataFrame) -> DataFrame:
    """The first stay of each admission, one row per admission."""
    return first_by(
        stays.where(F.col("hadm_id").isNotNull()).select("hadm_id", "intime", "icustay_id"),
        ["hadm_id"], "intime", "icustay_id",
    ).select("hadm_id", "icustay_id")


def suspicion_times(prescriptions: DataFrame, cultures: DataFrame, stays: DataFrame) -> DataFrame:
    """Earliest valid treatment and culture pair per stay."""
    first = first_stays(stays)
    given = drop_incomplete(
        prescriptions.where(match_any("drug", fv.DRUG_WORDS))
        .where(allow_or_null("route", fv.SYSTEMIC_ROUTES))
        .select("hadm_id", F.col("startdate").alias("t")), ["hadm_id", "t"],
    )
    taken = drop_incomplete(
        cultures.where(match_any("spec_type_desc", fv.CULTURE_WORDS))
        .select("hadm_id", F.coalesce("charttime", "chartdate").alias("t")), ["hadm_id", "t"],
    ).dropDuplicates(["hadm_id", "t"])
    return pair_events(
        given.join(first, "hadm_id"), taken.join(first, "hadm_id"), "icustay_id", "t",
        name="suspected_infection_time",
    )


def label_cohort(stays: DataFrame, prescriptions: DataFrame, cultures: DataFrame,
                 chart: DataFrame, labs: DataFrame, infusion_intervals: DataFrame,
                 infusion_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cohort, hourly score) from the raw tables."""
    refs = suspicion_times(prescriptions, cultures, stays)
    placed = labs.join(first_stays(stays), "hadm_id")
    score = stored(hourly_score(
        stays, readings_from_codes(chart, placed, "icustay_id"),
        keep_codes(infusion_intervals, "itemid", fv.PRESSOR_INTERVAL_CODES),
        keep_codes(infusion_points, "itemid", fv.PRESSOR_POINT_CODES), "icustay_id",
    ), "hourly-score")
    cohort = label_entities(
        stays, score, refs, "icustay_id", "hour", "sofa", "intime", "suspected_infection_time"
    )
    return cohort, score


def stream_events(chart: DataFrame, labs: DataFrame, stays: DataFrame,
                  cohort: DataFrame) -> DataFrame:
    """Coded chart and lab rows of the cohort as plausible canonical events."""
    spark = chart.sparkSession
    kept = keep_ids(stays, cohort, "icustay_id")
    vitals = map_codes(
        drop_incomplete(keep_ids(chart, cohort, "icustay_id"), ["icustay_id", "valuenum"]),
        code_dimension(spark, ["carevue", "metavision"]), "itemid",
    ).withColumn("valuenum", convert_units("valuenum", "itemid"))
    own_labs = keep_ids(drop_incomplete(labs, ["hadm_id", "charttime", "valuenum"]), kept, "hadm_id")
    coded = map_codes(own_labs, code_dimension(spark, ["labevents"]), "itemid")
    placed = assign_interval(coded, kept, "hadm_id", "charttime", "icustay_id", "intime", "outtime")
    cols = ["icustay_id", "charttime", "signal_name", "valuenum"]
    both = vitals.select(*cols, F.lit("chartevents").alias("source_table")).unionByName(
        placed.select(*cols, F.lit("labevents").alias("source_table"))
    )
    return apply_bounds(both, bounds_dimension(spark), "signal_name", "valuenum").select(
        *cols, "source_table"
    )


def training_tables(windows: DataFrame, cohort: DataFrame, key: str = "icustay_id",
                    signals: list[str] = fv.SIGNALS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folds, sequence features, tree features) from a window sink."""
    labels = [f"label_{h}h" for h in fv.HORIZON_HOURS]
    table = stored(horizon_labels(drop_suffix(windows), cohort, key), "labelled")
    folds = stored(stratified_folds(cohort, key, "sepsis_label"), "folds")
    return (
        folds,
        sequence_features(table, folds, key, signals, labels),
        tree_features(table, key, signals, labels),
    )
