"""Onset finding, horizon labels, folds, fills and leave-one-fold-out statistics."""

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions.scalar import freshness, horizon_label, plus_hours, standardise
from pulsegrid.operators.ordered import lofo_medians, ordered_index, percentiles
from pulsegrid.operators.windows import forward_fill
from pulsegrid.session import stored


# --- baseline and onset ---------------------------------------------------------

def baseline_value(series: DataFrame, refs: DataFrame, key: str, ts: str, value: str,
                   start: str, ref: str, hours: int = fv.BASELINE_BACK_HOURS) -> DataFrame:
    """First value at or after max(start, ref - hours) per entity, else the last
    value. `refs` has one row per entity."""
    since = F.greatest(F.col(start), plus_hours(ref, -hours))
    joined = series.join(refs.select(key, since.alias("_since")), key)
    return joined.groupBy(key).agg(
        F.coalesce(
            F.min_by(value, F.when(F.col(ts) >= F.col("_since"), F.col(ts))),
            F.max_by(value, ts),
        ).alias("baseline")
    )


def first_rise(series: DataFrame, refs: DataFrame, key: str, ts: str, value: str, ref: str,
               rise: float = fv.RISE_POINTS, back: int = fv.RISE_BACK_HOURS,
               ahead: int = fv.RISE_AHEAD_HOURS) -> DataFrame:
    """First time in [ref - back, ref + ahead] with value - baseline >= rise.
    `refs` has one row per entity with its baseline; entities without one drop out."""
    inside = F.col(ts).between(plus_hours(ref, -back), plus_hours(ref, ahead))
    hit = inside & (F.col(value) - F.col("baseline") >= rise)
    return (
        series.join(refs.select(key, ref, "baseline"), key)
        .where(hit).groupBy(key).agg(F.min(ts).alias("onset_time"))
    )


def label_entities(entities: DataFrame, series: DataFrame, refs: DataFrame, key: str, ts: str,
                   value: str, start: str, ref: str) -> DataFrame:
    """One row per entity: label, onset and the reason for it."""
    # one row per entity with a reference time, used by both passes over the series
    known = stored(refs.select(key, ref).join(entities.select(key, start), key), "references")
    base = baseline_value(series, known, key, ts, value, start, ref)
    onset = first_rise(series, known.join(base, key), key, ts, value, ref)
    has_series = series.select(key).distinct().withColumn("_series", F.lit(True))
    has_ref = known.select(key).withColumn("_ref", F.lit(True))
    reason = (
        F.when(F.col("_series").isNull(), "no_sofa_data")
        .when(F.col("_ref").isNull(), "no_soi")
        .when(F.col("onset_time").isNotNull(), "sepsis")
        .otherwise("criteria_not_met")
    )
    return (
        entities.join(has_series, key, "left").join(has_ref, key, "left").join(onset, key, "left")
        .withColumn("excl_reason", reason)
        .withColumn("sepsis_label", F.col("onset_time").isNotNull().cast("int"))
        .withColumnRenamed("onset_time", "sepsis_onset_time")
        .drop("_series", "_ref")
    )


# --- labels ----------------------------------------------------------------------

def horizon_labels(windows: DataFrame, cohort: DataFrame, key: str,
                   hours: list[int] = fv.HORIZON_HOURS, end: str = "window_end_time",
                   positive: str = "sepsis_label", onset: str = "sepsis_onset_time") -> DataFrame:
    """Add label_<h>h per horizon; `cohort` has one row per entity."""
    side = cohort.select(key, F.col(positive).alias("_pos"), F.col(onset).alias("_onset"))
    return (
        windows.drop("label").join(side, key, "left")
        .withColumns({f"label_{h}h": horizon_label(end, "_onset", h, "_pos") for h in hours})
        .drop("_pos", "_onset")
    )


# --- folds -----------------------------------------------------------------------

def stratified_folds(entities: DataFrame, key: str, label: str, k: int = fv.FOLDS,
                     seed: int = fv.SEED) -> DataFrame:
    """Deal the entities of each class in hash order to k folds, so every class is
    spread evenly to within one entity."""
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    each = entities.groupBy(key).agg(F.max(label).alias(label)).withColumn("_draw", draw)
    dealt = ordered_index(each, [label], [F.col("_draw"), F.col(key)])
    return dealt.select(key, label, (F.col("idx") % k).cast("int").alias("fold"))


def fold_table(cohort: DataFrame, windows: DataFrame, folds: DataFrame, key: str,
               positive: str, label: str) -> DataFrame:
    """Entities, positives, windows, positive windows and prevalence per fold,
    with a total row (fold is null there)."""
    per_entity = (
        cohort.select(key, positive).join(folds.select(key, "fold"), key, "left")
        .select("fold", F.lit(1).alias("_e"), F.col(positive).alias("_p"),
                F.lit(0).alias("_w"), F.lit(0).alias("_l"))
    )
    per_window = (
        windows.select(key, label).join(folds.select(key, "fold"), key, "left")
        .select("fold", F.lit(0).alias("_e"), F.lit(0).alias("_p"),
                F.lit(1).alias("_w"), F.col(label).alias("_l"))
    )
    return per_entity.unionByName(per_window).rollup("fold").agg(
        F.sum("_e").alias("n_entities"), F.sum("_p").alias("n_positive"),
        (F.sum("_e") - F.sum("_p")).alias("n_negative"),
        F.sum("_w").alias("n_windows"), F.sum("_l").alias("n_positive_windows"),
        F.try_divide(F.sum("_l") * 100.0, F.sum("_w")).alias("prevalence_pct"),
        F.grouping("fold").cast("int").alias("is_total"),
    )


def class_weight(df: DataFrame, labels: list[str]) -> DataFrame:
    """Counts per class and the weight negatives / max(positives, 1), per label."""
    long = df.select(*labels).unpivot([], labels, "label", "y")
    return long.groupBy("label").agg(
        F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg")
    ).withColumn("weight", F.col("n_neg") / F.greatest("n_pos", F.lit(1)))


# --- leave-one-fold-out statistics ------------------------------------------------

def _long(df: DataFrame, folds: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.select(key, *cols).join(folds.select(key, "fold"), key).unpivot(
        ["fold"], cols, "feature", "value"
    )


def lofo_median(df: DataFrame, folds: DataFrame, key: str, cols: list[str],
                k: int = fv.FOLDS) -> DataFrame:
    """(feature, fold, median over the other folds); 0 where they hold no value."""
    found = lofo_medians(_long(df, folds, key, cols), ["feature"], "fold", "value", k)
    spark = df.sparkSession
    every = spark.createDataFrame([(c, j) for c in cols for j in range(k)], "feature string, fold int")
    return every.join(found, ["feature", "fold"], "left").select(
        "feature", "fold", F.coalesce("median", F.lit(0.0)).alias("median")
    )


def lofo_moments(df: DataFrame, folds: DataFrame, key: str, cols: list[str],
                 k: int = fv.FOLDS) -> DataFrame:
    """(feature, fold, n, mean, sd) over the other folds.

    Each fold is reduced to count, mean and squared deviation; the k small rows per
    feature are then merged around the overall mean, which keeps the sum of squares
    free of cancellation.
    """
    long = _long(df, folds, key, cols)
    part = stored(long.where(F.col("value").isNotNull()).groupBy("feature", "fold").agg(
        F.count("value").alias("n"), F.mean("value").alias("m"),
        (F.var_pop("value") * F.count("value")).alias("ss"),
    ), "fold-moments")
    centre = part.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: j != F.col("fold"))
    merged = (
        part.join(centre, "feature")
        .withColumn("_left_out", F.explode(others))
        .groupBy("feature", F.col("_left_out").cast("int").alias("fold"), "g")
        .agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
            F.sum(F.col("ss") + F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g")))
            .alias("_ss"),
        )
    )
    shift = F.col("n") * (F.col("mean") - F.col("g")) * (F.col("mean") - F.col("g"))
    return merged.select(
        "feature", "fold", "n", "mean",
        F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("_ss") - shift, F.lit(0.0)) / (F.col("n") - 1)))
        .alias("sd"),
    )


def leakage_check(df: DataFrame, folds: DataFrame, key: str, cols: list[str],
                  stored: DataFrame, k: int = fv.FOLDS, tolerance: float = 1e-9) -> DataFrame:
    """Recompute every median the other way round (copy rows to the folds they
    train, then take a percentile) and count stored medians that differ."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: j != F.col("fold"))
    copied = _long(df, folds, key, cols).select(
        "feature", F.explode(others).alias("_left_out"), "value"
    ).withColumnRenamed("_left_out", "fold")
    again = percentiles(copied, ["feature", "fold"], "value", {"expected": 0.5})
    return stored.join(again, ["feature", "fold"], "left").agg(
        F.count("*").alias("n_checked"),
        F.count_if(F.abs(F.col("median") - F.coalesce("expected", F.lit(0.0))) > tolerance)
        .alias("n_leaks"),
    )


# --- fills and feature sets --------------------------------------------------------

def fill_and_impute(df: DataFrame, folds: DataFrame, key: str, cols: list[str],
                    k: int = fv.FOLDS, medians: DataFrame | None = None) -> DataFrame:
    """Forward fill, then the median of the other folds for leading nulls."""
    if medians is None:
        medians = lofo_median(df, folds, key, cols, k)
    # k rows: one per fold, one column per feature
    wide = medians.groupBy("fold").agg(*[
        F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_m_{c}") for c in cols
    ])
    filled = forward_fill(df, key, cols)
    joined = filled.join(folds.select(key, "fold"), key, "left").join(
        F.broadcast(wide), "fold", "left"
    )
    return joined.select(*[
        F.coalesce(c, f"_m_{c}").alias(c) if c in cols else F.col(c) for c in df.columns
    ])


def sequence_features(df: DataFrame, folds: DataFrame, key: str, signals: list[str],
                      labels: list[str], k: int = fv.FOLDS) -> DataFrame:
    """Labels, filled <signal>_last and <signal>_fresh flags taken before the fill."""
    last = [f"{s}_last" for s in signals]
    ids = [key, "window_start_time", "window_end_time"]
    flagged = df.select(*ids, *labels, *last).withColumns(freshness(last))
    return fill_and_impute(flagged, folds, key, last, k)


def tree_features(df: DataFrame, key: str, signals: list[str], labels: list[str],
                  stats: list[str] = fv.TREE_STATS) -> DataFrame:
    cols = [f"{s}_{t}" for s in signals for t in stats]
    return df.select(key, "window_start_time", "window_end_time", *labels, *cols)


def standardised(df: DataFrame, folds: DataFrame, key: str, cols: list[str],
                 moments: DataFrame) -> DataFrame:
    """Scale each row with the mean and sd of the folds it is not in."""
    wide = moments.groupBy("fold").agg(*[
        F.max(F.when(F.col("feature") == c, F.col(stat))).alias(f"_{stat}_{c}")
        for c in cols for stat in ("mean", "sd")
    ])
    joined = df.join(folds.select(key, "fold"), key).join(F.broadcast(wide), "fold")
    return joined.select(*[
        standardise(c, f"_mean_{c}", f"_sd_{c}").alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])


def ordered_ecdf(df: DataFrame, col: str, tie: str) -> DataFrame:
    """Each value with the share of rows at or before it in (value, tie) order."""
    ranked = ordered_index(
        df.where(F.col(col).isNotNull()), [], [F.col(col), F.col(tie)], "_i", total="_n"
    )
    return ranked.withColumn("cdf", (F.col("_i") + 1) / F.col("_n")).drop("_i", "_n")
