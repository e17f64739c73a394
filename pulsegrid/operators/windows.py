"""Sliding-window features and per-entity window operators."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions.scalar import hours_between
from pulsegrid.operators.blocks import grid_forward_fill, grid_index


def _seconds(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts)).cast("double")


def last_order(ts: str, tie: str | None, row: list[str]) -> Column:
    """Time, then tie column, as one decimal: 18 digits of microseconds, which the years 1 to 9999
    fit, and 20 digits of a whole number of 64 bits.

    A decimal is a fixed-width aggregation buffer, so max_by stays a hash
    aggregate; ordering by a struct would make Spark sort every input row.
    A null tie counts as 0. Without a tie column a hash of the row decides, which is
    still repeatable.
    """
    second = F.coalesce(F.col(tie), F.lit(0)) if tie else F.xxhash64(*row)
    micros = F.unix_micros(ts).cast("decimal(18,0)")
    return (
        micros * F.lit(Decimal(10**20)) + second.cast("decimal(19,0)") + F.lit(Decimal(2**63))
    ).cast("decimal(38,0)")


def _stats(value: Column, seconds: Column, order: Column, stats: list[str]) -> dict[str, Column]:
    every = {
        "mean": F.mean(value),
        "stddev": F.stddev_samp(value),
        "min": F.min(value),
        "max": F.max(value),
        "last": F.max_by(value, F.when(value.isNotNull(), order)),
        "slope": F.regr_slope(value, seconds),
    }
    return {name: every[name] for name in stats}


def signal_stats(signals: list[str], signal: str, value: str, ts: str,
                 tie: str | None = None, key: str | None = None,
                 stats: list[str] = fv.STATS) -> list[Column]:
    """signals x statistics conditional aggregates: the pivot a stream can run."""
    row = [c for c in (key, signal, value) if c]
    order = last_order(ts, tie, row)
    out = []
    for s in signals:
        mine = F.col(signal) == s
        aggs = _stats(F.when(mine, F.col(value)), F.when(mine, _seconds(ts)), order, stats)
        out += [agg.alias(f"{s}_{name}") for name, agg in aggs.items()]
    return out


def latency_stats(latency: str = "latency_ms") -> list[Column]:
    return [
        F.mean(latency).alias("avg_latency_ms"),
        F.min(latency).alias("min_latency_ms"),
        F.max(latency).alias("max_latency_ms"),
        F.count("*").alias("n_events"),
    ]


def signal_windows(df: DataFrame, key: str, ts: str, signal: str, value: str,
                   signals: list[str] = fv.SIGNALS, tie: str | None = None,
                   width: str = fv.WINDOW_WIDTH, slide: str = fv.WINDOW_SLIDE,
                   latency: str | None = None, stats: list[str] = fv.STATS) -> DataFrame:
    """One row per entity, sliding window and signal, for `widen`; rows of other signals count as a null one.

    Each row updates one set of aggregates and not one per signal, and a stream's state is as wide
    as one signal. All signals of a window close in the same micro-batch.
    """
    known = F.when(F.col(signal).isin(signals), F.col(signal)).alias("_signal")
    order = last_order(ts, tie, [key, signal, value])
    return df.groupBy(key, F.window(F.col(ts), width, slide), known).agg(
        *[a.alias(f"_{n}") for n, a in _stats(F.col(value), _seconds(ts), order, stats).items()],
        F.count("*").alias("_n"),
        *([F.sum(latency).alias("_lsum"), F.count(latency).alias("_lcount"),
           F.min(latency).alias("_lmin"), F.max(latency).alias("_lmax")] if latency else []),
    )


def widen(long: DataFrame, key: str, signals: list[str] = fv.SIGNALS, latency: bool = False,
          stats: list[str] = fv.STATS) -> DataFrame:
    """The rows of `signal_windows` turned sideways: a table, or one micro-batch of a stream."""
    # at most one entry per signal: far smaller than signals x statistics buffers
    entry = F.struct("_signal", F.struct(*[F.col(f"_{n}").alias(n) for n in stats]))
    aggs = [F.map_from_entries(
        F.collect_list(F.when(F.col("_signal").isNotNull(), entry))
    ).alias("_by_signal")]
    if latency:
        aggs += [
            F.try_divide(F.sum("_lsum"), F.sum("_lcount")).alias("avg_latency_ms"),
            F.min("_lmin").alias("min_latency_ms"),
            F.max("_lmax").alias("max_latency_ms"),
        ]
    wide = long.groupBy(key, "window").agg(*aggs, F.sum("_n").alias("n_events")).select("*", *[
        F.col("_by_signal")[s][n].alias(f"{s}_{n}") for s in signals for n in stats
    ])
    return _named(wide, key, signals, latency, stats)


def _named(wide: DataFrame, key: str, signals: list[str], latency: bool, stats: list[str]) -> DataFrame:
    names = [f"{s}_{n}" for s in signals for n in stats]
    if latency:
        names += ["avg_latency_ms", "min_latency_ms", "max_latency_ms"]
    return wide.select(
        key,
        F.col("window.start").alias("window_start_time"),
        F.col("window.end").alias("window_end_time"),
        *names, "n_events",
    )


def sliding_features(df: DataFrame, key: str, ts: str, signal: str, value: str,
                     signals: list[str] = fv.SIGNALS, tie: str | None = None,
                     width: str = fv.WINDOW_WIDTH, slide: str = fv.WINDOW_SLIDE,
                     latency: str | None = None, stats: list[str] = fv.STATS) -> DataFrame:
    """One row per entity and sliding window: the statistics of each signal, bounds,
    event count and, when asked, latency.

    A stream cannot pivot and may shuffle only once, so it runs the conditional
    aggregates; one whose sink takes micro-batches runs `signal_windows` and leaves `widen` to the
    sink, as a batch does with its few rows per signal. All give the same table.
    """
    if not df.isStreaming:
        long = signal_windows(df, key, ts, signal, value, signals, tie, width, slide, latency, stats)
        return widen(long, key, signals, bool(latency), stats)
    aggs = signal_stats(signals, signal, value, ts, tie, key, stats)
    aggs += latency_stats(latency) if latency else [F.count("*").alias("n_events")]
    wide = df.groupBy(key, F.window(F.col(ts), width, slide)).agg(*aggs)
    return _named(wide, key, signals, bool(latency), stats)


def temporal_features(df: DataFrame, key: str, ts: str = "window_start_time") -> DataFrame:
    """Position, relative position and hours since the entity's first window."""
    out = grid_index(df, [key], ts, "window_idx", total="_total", first="_first")
    last = F.greatest(F.col("_total") - 1, F.lit(1))
    return out.withColumns({
        "window_idx_norm": F.col("window_idx") / last,
        "hours_in_icu": hours_between("_first", ts),
    }).drop("_total", "_first")


def forward_fill(df: DataFrame, key: str, cols: list[str],
                 ts: str = "window_start_time") -> DataFrame:
    return grid_forward_fill(df, [key], ts, cols)


def last_n(df: DataFrame, key: str, n: int = fv.SEQUENCE_STEPS,
           ts: str = "window_start_time") -> DataFrame:
    """The latest n grid rows of each entity."""
    out = grid_index(df, [key], ts, "_idx", total="_total")
    return out.where(F.col("_idx") >= F.col("_total") - n).drop("_idx", "_total")


def lagged(df: DataFrame, key: str, cols: list[str], lags: list[int],
           ts: str = "window_start_time", block: int = 4096) -> DataFrame:
    """Add <c>_lag<i>: the value i rows earlier within the entity.

    An entity's rows are cut into blocks of positions; the few rows at a border that lags reach
    over are sent to the neighbour as well, so a hot entity is spread like any other set of rows.
    """
    back, ahead = max([0, *lags]), max([0, *[-i for i in lags]])
    block = max(block, back, ahead)
    at = F.col("_idx") % block
    reach = [F.lit(0)]
    if back:
        reach.append(F.when(at >= block - back, F.lit(1)))
    if ahead:
        reach.append(F.when(at < ahead, F.lit(-1)))
    sent = grid_index(df, [key], ts, "_idx").withColumn("_to", F.explode(F.array_compact(F.array(*reach))))
    sent = sent.withColumn("_part", F.floor(F.col("_idx") / block) + F.col("_to"))
    ordered = Window.partitionBy(key, "_part").orderBy("_idx")
    rest = [c for c in df.columns if c != key]
    return sent.select(
        key, *rest, "_to", *[F.lag(c, i).over(ordered).alias(f"{c}_lag{i}") for c in cols for i in lags]
    ).where(F.col("_to") == 0).drop("_to")


def sequence_table(df: DataFrame, key: str, features: list[str], labels: list[str],
                   n: int = fv.SEQUENCE_STEPS, ts: str = "window_start_time") -> DataFrame:
    """One row per entity: its latest n steps as ordered arrays, and their number.

    last_n comes first, so no array grows past n steps.
    """
    step = F.struct(
        F.col(ts).alias("t"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        F.array(*[F.col(c).cast("int") for c in labels]).alias("y"),
    )
    steps = last_n(df, key, n, ts).groupBy(key).agg(
        F.sort_array(F.collect_list(step)).alias("steps")
    )
    return steps.select(
        key,
        F.size("steps").alias("seq_len"),
        F.transform("steps", lambda s: s["t"]).alias("times"),
        F.transform("steps", lambda s: s["x"]).alias("x"),
        F.transform("steps", lambda s: s["y"]).alias("y"),
    )


def pad_sequences(df: DataFrame, n: int, n_features: int, n_labels: int) -> DataFrame:
    """Pad in front to n steps so the last step is always the latest; mask is
    True for real steps."""
    gap = F.lit(n) - F.col("seq_len")
    zeros = lambda value, width: F.array_repeat(F.array_repeat(F.lit(value), width), gap)
    return df.withColumns({
        "x": F.concat(zeros(0.0, n_features), "x"),
        "y": F.concat(zeros(0, n_labels), "y"),
        "mask": F.concat(
            F.array_repeat(F.lit(False), gap), F.array_repeat(F.lit(True), F.col("seq_len"))
        ),
    })


def first_by(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The first row per key by time, then by a whole-number column: one hash
    aggregate with map-side combine, so a hot key costs one row per partition."""
    order = last_order(ts, tie, [])
    picked = df.groupBy(*keys).agg(*[
        F.min_by(c, order).alias(c) for c in df.columns if c not in keys
    ])
    return picked.select(*df.columns)
