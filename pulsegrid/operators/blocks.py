"""Per-entity order operators for tables on a time grid.

A grid table has at most one row per entity and grid time, so an entity has a
known number of rows per day. The timeline of each entity is cut into blocks of
one day and shuffled on (entity, day). What has to cross a block border (a count,
a first time, a last value) is carried by one summary row per entity and day. A
hot entity is therefore spread over the cluster like any other set of rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = "_block"


def day_block(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def _join_carry(rows: DataFrame, carry: DataFrame, at: list[str]) -> DataFrame:
    cond = reduce(lambda a, b: a & b, [rows[n].eqNullSafe(carry[n]) for n in at])
    names = [c for c in carry.columns if c not in at]
    return rows.join(carry, cond, "left").select(rows["*"], *[carry[c] for c in names])


def grid_index(df: DataFrame, keys: list[str], ts: str, name: str = "idx",
               total: str | None = None, first: str | None = None) -> DataFrame:
    """Zero-based row number per entity in time order; optionally the entity's
    row count and first time."""
    cut = df.withColumn(BLOCK, day_block(ts))
    at = keys + [BLOCK]
    summary = cut.groupBy(*at).agg(F.count("*").alias("_n"), F.min(ts).alias("_first"))
    every = Window.partitionBy(*keys)
    before = every.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")]
    if total:
        carried.append(F.sum("_n").over(every).alias(total))
    if first:
        carried.append(F.min("_first").over(every).alias(first))
    local = Window.partitionBy(*at).orderBy(ts)
    rows = cut.withColumn("_local", F.row_number().over(local) - 1)
    out = _join_carry(rows, summary.select(*at, *carried), at)
    return out.withColumn(name, F.col("_local") + F.col("_before")).drop(
        BLOCK, "_local", "_before"
    )


def grid_forward_fill(df: DataFrame, keys: list[str], ts: str, cols: list[str]) -> DataFrame:
    """Replace nulls by the entity's latest earlier value; leading nulls stay."""
    cut = df.withColumn(BLOCK, day_block(ts))
    at = keys + [BLOCK]
    summary = cut.groupBy(*at).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_s_{c}") for c in cols
    ])
    before = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = summary.select(
        *at, *[F.last(f"_s_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in cols]
    )
    local = (
        Window.partitionBy(*at).orderBy(ts)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = cut.withColumns(
        {f"_l_{c}": F.last(c, ignorenulls=True).over(local) for c in cols}
    )
    out = _join_carry(rows, carry, at)
    return out.select(*[
        F.coalesce(f"_l_{c}", f"_c_{c}").alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])
