"""Risk roll-ups, alert reports and run summaries."""

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions.scalar import hour_bin
from pulsegrid.operators.blocks import grid_index
from pulsegrid.operators.quality import covered_rows, group_share, histogram, size_stats

SCORES = ["score_6h", "score_12h", "score_24h"]


def entity_risk(pred: DataFrame, key: str) -> DataFrame:
    """Highest scores, windows, alerts and first alert per entity."""
    return pred.groupBy(key).agg(
        *[F.max(s).alias(f"max_{s}") for s in SCORES],
        F.count("score_6h").alias("n_windows"),
        F.sum("alert").alias("n_alerts"),
        F.min(F.when(F.col("alert") == 1, F.col("window_end_time"))).alias("first_alert"),
    )


def alert_rate(pred: DataFrame, key: str, score: str = "score_12h",
               threshold: float = fv.ALERT_THRESHOLD) -> DataFrame:
    """Share of windows at or over the threshold per hour since the first window."""
    binned = grid_index(pred, [key], "window_start_time", "_idx").withColumn(
        "hour_bin", hour_bin("_idx")
    )
    return binned.groupBy("hour_bin").agg(
        F.mean(F.coalesce((F.col(score) >= threshold).cast("double"), F.lit(0.0))).alias("alert_rate"),
        F.count(score).alias("n_windows"),
    )


def top_alerts(pred: DataFrame, key: str, score: str = "score_6h", k: int = 10) -> DataFrame:
    """The k highest alerts; ties go to the earlier window, then the smaller key."""
    return pred.where(F.col("alert") == 1).orderBy(
        F.col(score).desc(), "window_end_time", key
    ).limit(k)


def top_entities(pred: DataFrame, key: str, score: str = "max_score_12h", k: int = 15) -> DataFrame:
    return entity_risk(pred, key).orderBy(F.col(score).desc(), key).limit(k)


def top_trajectory(pred: DataFrame, key: str, score: str = "max_score_12h") -> DataFrame:
    """All windows of the entity with the highest score."""
    best = top_entities(pred, key, score, 1).select(key)
    return pred.join(best, key, "left_semi")


def top_importance(importance: DataFrame, k: int = 20) -> DataFrame:
    """The k most important features, renormalised to percent among themselves."""
    best = importance.orderBy(F.col("importance").desc(), "feature").limit(k)
    total = best.agg(F.sum("importance")).scalar()
    return best.withColumn("importance_pct", F.try_divide(F.col("importance") * 100.0, total))


def run_summary(pred: DataFrame, key: str, threshold: float = fv.ALERT_THRESHOLD) -> DataFrame:
    """Entities, windows, events, alerts and mean scores of a scoring run.

    Entities are counted from one row per entity: an exact distinct count next to
    other aggregates would copy every row once more.
    """
    per_entity = pred.groupBy(key).agg(
        F.count("*").alias("_w"), F.sum("n_events").alias("_e"),
        *[F.sum((F.col(s) >= threshold).cast("long")).alias(f"_a_{s}") for s in SCORES],
        *[F.sum(s).alias(f"_s_{s}") for s in SCORES],
        *[F.count(s).alias(f"_n_{s}") for s in SCORES],
    )
    return per_entity.agg(
        F.count("*").alias("n_entities"), F.sum("_w").alias("n_windows"),
        F.sum("_e").alias("n_events"),
        *[F.sum(f"_a_{s}").alias(f"alerts_{s}") for s in SCORES],
        *[F.try_divide(F.sum(f"_a_{s}") * 100.0, F.sum("_w")).alias(f"alert_pct_{s}") for s in SCORES],
        *[F.try_divide(F.sum(f"_s_{s}"), F.sum(f"_n_{s}")).alias(f"mean_{s}") for s in SCORES],
    )


def label_prevalence(df: DataFrame, labels: list[str]) -> DataFrame:
    """Positives, negatives and percent positive per horizon."""
    long = df.select(*labels).unpivot([], labels, "label", "y")
    return long.groupBy("label").agg(
        F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"),
        (F.mean(F.col("y").cast("double")) * 100.0).alias("positive_pct"),
    )


def throughput(df: DataFrame, produced_ms: str, written_ms: str) -> DataFrame:
    """Wall clock from the first produced stamp to the last written one, and rate."""
    span = (F.max(written_ms) - F.min(produced_ms)) / 1000.0
    return df.agg(
        F.count("*").alias("n_events"), span.alias("wall_clock_s"),
        F.when(span > 0, F.count("*") / span).otherwise(F.lit(0.0)).alias("events_per_s"),
    )


def windows_report(windows: DataFrame, key: str, label: str, features: list[str]) -> dict[str, DataFrame]:
    """The post-run tables over a window sink."""
    sizes = windows.groupBy(key).agg(F.count("*").alias("n"))
    return {
        "labels": group_share(windows, [label]),
        "sizes": size_stats(windows, key),
        "size_histogram": histogram(sizes, "n", None),
        "coverage": covered_rows(windows, features),
    }
