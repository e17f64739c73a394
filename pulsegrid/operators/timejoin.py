"""Joins in time: pairing, intervals, hourly grids and as-of fills.

No operator here matches all rows of a key with each other. Ranges become equal
keys first: a day or hour bucket, or a summary row per bucket.
"""

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions.scalar import ceil_hour, plus_hours
from pulsegrid.operators.blocks import grid_forward_fill
from pulsegrid.operators.sweep import nearest_intervals
from pulsegrid.operators.windows import last_order
from pulsegrid.session import stored


# --- pairing --------------------------------------------------------------------

def _earliest_followed(lead: DataFrame, follow: DataFrame, key: str, ts: str,
                       hours: int, allow_equal: bool) -> DataFrame:
    """Earliest lead time per key that has a follow time within `hours` after it.

    With buckets as wide as the span, a follow-up can only lie in the lead's own
    bucket, where the latest one decides, or in the next one, where the earliest
    decides. Two numbers per bucket therefore replace all pairs.
    """
    width = F.lit(hours * 3_600_000_000)
    bucket = lambda col: F.floor(F.unix_micros(col) / width)
    ends = follow.groupBy(key, bucket(F.col(ts)).alias("_bucket")).agg(
        F.min(ts).alias("_min"), F.max(ts).alias("_max")
    )
    near = ends.select(key, F.explode(F.array(
        F.struct(F.col("_bucket").alias("_bucket"), F.col("_max").alias("_own"),
                 F.lit(None).cast("timestamp").alias("_next")),
        F.struct((F.col("_bucket") - 1).alias("_bucket"),
                 F.lit(None).cast("timestamp").alias("_own"), F.col("_min").alias("_next")),
    )).alias("_s")).select(key, "_s.*")
    near = near.groupBy(key, "_bucket").agg(F.max("_own").alias("_own"), F.max("_next").alias("_next"))
    leads = lead.select(key, ts).distinct().withColumn("_bucket", bucket(F.col(ts)))
    own = F.col("_own") >= F.col(ts) if allow_equal else F.col("_own") > F.col(ts)
    followed = own | (F.col("_next") <= plus_hours(ts, hours))
    return (
        leads.join(near, [key, "_bucket"])
        .where(F.coalesce(own, F.lit(False)) | F.coalesce(followed, F.lit(False)))
        .groupBy(key).agg(F.min(ts).alias(ts))
    )


def pair_events(a: DataFrame, b: DataFrame, key: str, ts: str,
                forward_hours: int = fv.PAIR_FORWARD_HOURS,
                back_hours: int = fv.PAIR_BACK_HOURS, name: str = "pair_time") -> DataFrame:
    """Earliest time per key of a valid pair: a then b within forward_hours counts
    at a (equal times included); b then a within back_hours counts at b."""
    first = _earliest_followed(a, b, key, ts, forward_hours, allow_equal=True)
    second = _earliest_followed(b, a, key, ts, back_hours, allow_equal=False)
    return first.unionByName(second).groupBy(key).agg(F.min(ts).alias(name))


# --- intervals --------------------------------------------------------------------

def assign_interval(points: DataFrame, intervals: DataFrame, key: str, ts: str,
                    interval_id: str, start: str, end: str,
                    grace_hours: int = fv.INTERVAL_GRACE_HOURS, max_gap_hours: float | None = None,
                    block_hours: int = 6) -> DataFrame:
    """Each point gets one interval of its key: among those covering it (with
    grace at both ends) the one starting nearest, else the nearest start at all.
    Equal gaps go to the smaller id, of any type. An interval with an open end covers
    nothing but can be the nearest. Points of keys without intervals drop out, as do
    null keys and times; points need no id and repeated ones stay repeated. With `max_gap_hours`
    a point that no interval covers only takes a start at most so far away, and drops out else.

    Adds interval_id and covered to the points. Points and intervals of a key meet in blocks of
    `block_hours`, where a sweep in the order of time takes the place of pairs.
    """
    found = nearest_intervals(points, intervals, key, ts, interval_id, start, end,
                              grace_hours * 3_600_000_000, block_hours)
    if max_gap_hours is not None:
        found = found.where(F.col("covered") | (F.col("_gap") <= F.lit(int(max_gap_hours * 3_600_000_000))))
    return found.drop("_gap")


HOURS_A_TASK = 1_000_000


def _spread_by_hours(intervals: DataFrame, key: str) -> DataFrame:
    """Deal intervals _a to _b so that a task makes about HOURS_A_TASK hours: the few bytes of an interval tell
    nothing about its hours, and adaptive execution would put all of them into a few tasks."""
    kept = stored(intervals, "intervals")
    hours = kept.agg(F.sum(F.timestamp_diff("HOUR", F.col("_a"), F.col("_b")) + 1)).first()[0] or 0
    return kept.repartition(-(-hours // HOURS_A_TASK), key, "_a") if hours > HOURS_A_TASK else kept


def hours_covered(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The distinct whole hours h with start <= h <= end, per key."""
    valid = intervals.select(key, start, end).distinct().select(
        key, ceil_hour(start).alias("_a"), F.date_trunc("hour", F.col(end)).alias("_b")
    ).where(F.col("_a") <= F.col("_b")).distinct()
    return _spread_by_hours(valid, key).select(
        key, F.explode(F.sequence("_a", "_b", F.expr("interval 1 hour"))).alias("hour")
    ).distinct()


def hourly_spine(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """One row per whole hour inside each interval; reversed intervals give none."""
    return hours_covered(intervals.where(F.col(end) > F.col(start)), key, start, end)


def hours_marked(points: DataFrame, key: str, ts: str) -> DataFrame:
    """The distinct hours that hold a point, per key."""
    return points.select(key, F.date_trunc("hour", F.col(ts)).alias("hour")).distinct()


def flag_hours(grid: DataFrame, hours: DataFrame, key: str, name: str) -> DataFrame:
    """True for the grid hours found in a table of distinct (key, hour)."""
    hits = hours.select(key, "hour").withColumn(name, F.lit(True))
    return grid.join(hits, [key, "hour"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def covered_flag(grid: DataFrame, intervals: DataFrame, key: str, start: str, end: str,
                 name: str = "covered") -> DataFrame:
    """True for grid hours inside any interval, both ends included."""
    return flag_hours(grid, hours_covered(intervals, key, start, end), key, name)


def bucket_flag(grid: DataFrame, points: DataFrame, key: str, ts: str,
                name: str = "marked") -> DataFrame:
    """True for the grid hour a point falls in."""
    return flag_hours(grid, hours_marked(points, key, ts), key, name)


# --- hourly values ------------------------------------------------------------------

def hourly_last(points: DataFrame, key: str, ts: str, value: str, tie: str | None = None) -> DataFrame:
    """The last value inside each hour that has one."""
    order = last_order(ts, tie, [value])
    return points.where(F.col(value).isNotNull()).groupBy(
        key, F.date_trunc("hour", F.col(ts)).alias("hour")
    ).agg(F.max_by(value, order).alias(value))


def asof_fill(grid: DataFrame, points: DataFrame, key: str, ts: str, name: str, value: str,
              names: list[str], tie: str | None = None, since: DataFrame | None = None) -> DataFrame:
    """Give every grid hour, per name, the last value known at or before it.

    `since` (key, since) tells from when on the points of each key count, such as the
    admission; earlier ones are not carried into the grid.

    `points` is long (key, ts, name, value). Points are first reduced to the last one
    per key, name and hour they are known at, so what is carried forward has grid size
    however many points there are. That small table is stored, because the fill reads
    it twice and the points must be read once.
    """
    if since is not None:
        first = since.groupBy(key).agg(F.min("since").alias("_since"))
        points = points.join(first, key).where(F.col(ts) >= F.col("_since")).drop("_since")
    latest = (
        points.where(F.col(value).isNotNull() & F.col(name).isin(names))
        .groupBy(key, ceil_hour(ts).alias("hour"), F.col(name).alias("_name"))
        .agg(F.max_by(value, last_order(ts, tie, [value])).alias("_value"))
    )
    rest = [c for c in grid.columns if c not in (key, "hour")]
    both = (
        grid.withColumn("_grid", F.lit(True))
        .unionByName(latest, allowMissingColumns=True)
        .groupBy(key, "hour")
        .agg(F.max("_grid").alias("_grid"), *[F.first(c, ignorenulls=True).alias(c) for c in rest],
             *[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in names])  # one row each
    )
    return grid_forward_fill(stored(both, "asof-grid"), [key], "hour", names).where("_grid").drop("_grid")


def sum_parts(points: DataFrame, key: str, ts: str, part: str, value: str,
              parts: int = fv.COMA_PARTS) -> DataFrame:
    """Sum of the parts charted at one instant, only where all parts are there."""
    return (
        points.where(F.col(value).isNotNull())
        .groupBy(key, ts)
        .agg(F.sum(value).alias(value), F.size(F.collect_set(part)).alias("_parts"))
        .where(F.col("_parts") == parts)
        .drop("_parts")
    )
