"""Data quality, distribution and reconciliation tables."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions.scalar import plus_hours, split_feature
from pulsegrid.operators.ordered import percentiles
from pulsegrid.session import stored


def group_share(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row count per group and its share of all rows. The counts are stored, so the
    total comes from them and not from a second pass over the rows."""
    counts = stored(df.groupBy(*keys).agg(F.count("*").alias("n_rows")), "counts")
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.withColumn("share", F.col("n_rows") / total)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table; nulls where it is empty."""
    found = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("_row", found).select(
        *df.columns, *[F.col("_row")[c].alias(c) for c in row.columns]
    )


def size_stats(df: DataFrame, key: str) -> DataFrame:
    """Groups and the min, max, mean and exact median of their sizes."""
    sizes = df.groupBy(key).agg(F.count("*").cast("double").alias("n"))
    counts = stored(sizes.groupBy("n").agg(F.count("*").alias("w")), "sizes")
    part = counts.agg(
        F.sum("w").alias("n_groups"), F.min("n").cast("long").alias("min_size"),
        F.max("n").cast("long").alias("max_size"),
        (F.sum(F.col("n") * F.col("w")) / F.sum("w")).alias("mean_size"),
    )
    return with_row(part, percentiles(counts, [], "n", {"median_size": 0.5}, weight="w"))


def _edges(values: DataFrame, bins: int | None, *extra: Column) -> Column:
    """(lo, hi, bins, extra...) of the values as one scalar subquery."""
    lo, hi = F.min("_v"), F.max("_v")
    n = F.lit(bins) if bins else F.least(F.lit(10), F.count_distinct("_v")).cast("int")
    flat = lo == hi
    return values.agg(F.struct(
        F.when(flat, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(flat, hi + 0.5).otherwise(hi).alias("hi"), n.alias("bins"), *extra,
    )).scalar()


def _spine(spark, edges: Column) -> DataFrame:
    """One row per bin with its bounds; no rows when there are no values."""
    e, width = F.col("_e"), (F.col("_e.hi") - F.col("_e.lo")) / F.col("_e.bins")
    return spark.range(1).select(edges.alias("_e")).where(F.col("_e.lo").isNotNull()).select(
        "_e", F.explode(F.sequence(F.lit(0), F.col("_e.bins") - 1)).alias("bin")
    ).select(
        "_e", "bin", (e["lo"] + F.col("bin") * width).alias("bin_lo"),
        (e["lo"] + (F.col("bin") + 1) * width).alias("bin_hi"),
    )


def _bin(edges: Column) -> Column:
    width = (edges["hi"] - edges["lo"]) / edges["bins"]
    return F.least(F.floor((F.col("_v") - edges["lo"]) / width), edges["bins"] - 1).cast("int")


def histogram(df: DataFrame, col: str, bins: int | None = 10) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed, empty bins kept.

    bins=None takes 10 or, if fewer, the number of distinct values. A constant
    column is spread half a unit to both sides.
    """
    values = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_v"))
    edges = _edges(values, bins)
    placed = values.withColumn("_e", edges).groupBy(_bin(F.col("_e")).alias("bin")).agg(
        F.count("*").alias("n")
    )
    return _spine(df.sparkSession, edges).join(placed, "bin", "left").select(
        "bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("n")
    )


def score_drift(a: DataFrame, b: DataFrame, col_a: str, col_b: str, bins: int = 50) -> DataFrame:
    """Counts and densities of two score columns on shared bins."""
    side = lambda df, col, is_a: df.where(F.col(col).isNotNull()).select(
        F.col(col).cast("double").alias("_v"), F.lit(is_a).alias("_a")
    )
    values = side(a, col_a, True).unionAll(side(b, col_b, False))
    edges = _edges(values, bins, F.count_if("_a").alias("a"), F.count_if(~F.col("_a")).alias("b"))
    placed = values.withColumn("_e", edges).groupBy(_bin(F.col("_e")).alias("bin")).agg(
        F.count_if("_a").alias("n_a"), F.count_if(~F.col("_a")).alias("n_b")
    )
    width = F.col("bin_hi") - F.col("bin_lo")
    density = lambda n: F.try_divide(
        F.coalesce(f"n_{n}", F.lit(0)).cast("double"), F.col(f"_e.{n}") * width
    )
    return _spine(a.sparkSession, edges).join(placed, "bin", "left").select(
        "bin", "bin_lo", "bin_hi",
        F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"),
        density("a").alias("density_a"), density("b").alias("density_b"),
    )


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sd, min, exact quartiles and max."""
    part = df.agg(
        F.count(col).alias("n"), F.mean(col).alias("mean"), F.stddev_samp(col).alias("sd"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    return with_row(part, percentiles(df, [], col, {"p25": 0.25, "p50": 0.5, "p75": 0.75}))


def latency_summary(df: DataFrame, col: str = "avg_latency_ms") -> DataFrame:
    """p50, p95, p99, mean, min and max, exact and interpolated. The window latencies
    are stored first, as they are read twice."""
    kept = stored(df.select(col), "latencies")
    part = kept.agg(F.mean(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))
    return with_row(part, percentiles(kept, [], col, {"p50": 0.5, "p95": 0.95, "p99": 0.99}))


# --- nulls ---------------------------------------------------------------------------

def null_rates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null count and percent per column, one scan, long form."""
    wide = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    long = wide.unpivot(["_n"], cols, "feature", "null_count")
    signal, stat = split_feature("feature")
    return long.select(
        "feature", signal.alias("signal"), stat.alias("stat"), "null_count",
        F.round(F.try_divide(F.col("null_count") * 100.0, F.col("_n")), 2).alias("null_pct"),
    )


def null_by_stat(rates: DataFrame) -> DataFrame:
    return rates.groupBy("stat").agg(
        F.mean("null_pct").alias("mean_null_pct"), F.min("null_pct").alias("min_null_pct"),
        F.max("null_pct").alias("max_null_pct"),
    )


def null_delta(rates: DataFrame, margin: float = 0.1) -> DataFrame:
    """Null rate of _last against _mean per signal, and what the gap means."""
    both = rates.where(F.col("stat").isin("mean", "last")).groupBy("signal").agg(
        F.max(F.when(F.col("stat") == "mean", F.col("null_pct"))).alias("mean_pct"),
        F.max(F.when(F.col("stat") == "last", F.col("null_pct"))).alias("last_pct"),
    )
    gap = F.col("last_pct") - F.col("mean_pct")
    return both.withColumn("delta", gap).withColumn(
        "marker",
        F.when(gap > margin, "fill would help").when(gap < -margin, "fill active").otherwise(""),
    )


def range_check(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Share of fresh windows per signal against its expected range.

    `limits` (signal, lo, hi) is a fixed list with one row per signal.
    """
    cols = [c for c in df.columns if c.endswith("_fresh")]
    wide = df.agg(*[(F.mean((F.col(c) == 1).cast("double")) * 100).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "fresh_pct")
    signal, _ = split_feature("feature")
    checked = long.withColumn("signal", signal).join(F.broadcast(limits), "signal", "left")
    return checked.select(
        "signal", "fresh_pct",
        F.col("fresh_pct").between(
            F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(100.0))
        ).alias("in_range"),
    )


def covered_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with at least one of the features."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count(F.coalesce(*[F.col(c) for c in cols])).alias("n_covered"),
    ).withColumn("covered_pct", F.try_divide(F.col("n_covered") * 100.0, F.col("n_rows")))


# --- gates and funnels -----------------------------------------------------------------

def cohort_funnel(cohort: DataFrame, reason: str = "excl_reason") -> DataFrame:
    return group_share(cohort, [reason])


def gate(cohort: DataFrame, positive: str = "sepsis_label",
         limits: tuple[float, float] = fv.PREVALENCE_RANGE) -> DataFrame:
    """Prevalence and whether it lies inside the limits."""
    return cohort.agg(
        F.count("*").alias("n_total"),
        F.coalesce(F.sum(positive), F.lit(0)).cast("long").alias("n_positive"),
    ).withColumn(
        "prevalence", F.coalesce(F.try_divide("n_positive", "n_total"), F.lit(0.0))
    ).withColumn("passed", F.col("prevalence").between(*limits))


def require_gate(cohort: DataFrame, positive: str = "sepsis_label",
                 limits: tuple[float, float] = fv.PREVALENCE_RANGE) -> None:
    """Raise when the gate fails; the funnel is in the message."""
    row = gate(cohort, positive, limits).first()
    if not row["passed"]:
        raise ValueError(f"prevalence {row['prevalence']:.4f} is outside {limits}: {row.asDict()}")


def late_report(windows: DataFrame, latest: Column, end: str = "window_end_time",
                delay_hours: float = 1.0) -> DataFrame:
    """Windows an append-mode stream would still hold back: those ending after the
    latest event time less the delay."""
    open_ = F.col(end) > plus_hours(latest, -delay_hours)
    return windows.agg(
        F.count("*").alias("n_windows"), F.count_if(open_).alias("n_open"),
        F.count_if(~open_).alias("n_emitted"),
    )
