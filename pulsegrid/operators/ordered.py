"""Running totals and exact percentiles over orders of any length.

A plain window over one global or one hot ordering would put all of its rows in
a single task. Here the rows are range-partitioned on (keys, order), so a hot
key is cut into as many pieces as it needs; each piece is summed on its own, the
piece totals (one row per piece and key) are accumulated, and added back.

The range-partitioned rows are written out together with their piece number before
it is used: range bounds come from sampling, and a new sample must not move them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.session import stored

PIECE = "_piece"


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def range_pieces(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add the number of the contiguous (keys, order) range each row lies in."""
    by = [F.col(k) for k in keys] + order
    return stored(df.repartitionByRange(*by).withColumn(PIECE, F.spark_partition_id()), "pieces")


def running_sums(df: DataFrame, keys: list[str], order: list[Column],
                 sums: list[str], totals: bool = True) -> DataFrame:
    """Add cum_<c> (inclusive running sum) and tot_<c> per key for each column c.

    Rows that tie on the order share a range, so callers first aggregate to one
    row per (keys, order) or end the order with a unique column.
    """
    pieces = range_pieces(df, keys, order)
    at = keys + [PIECE]
    part = pieces.groupBy(*at).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    every = Window.partitionBy(*keys)
    before = every.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_c_{c}") for c in sums]
    if totals:
        carried += [F.sum(f"_t_{c}").over(every).alias(f"tot_{c}") for c in sums]
    carry = part.select(*at, *carried)
    local = (
        Window.partitionBy(*at).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = pieces.select("*", *[F.sum(c).over(local).alias(f"_l_{c}") for c in sums])
    out = rows.join(carry, _same(rows, carry, at), "left")
    keep = [rows[c] for c in df.columns]
    keep += [(rows[f"_l_{c}"] + carry[f"_c_{c}"]).alias(f"cum_{c}") for c in sums]
    if totals:
        keep += [carry[f"tot_{c}"] for c in sums]
    return out.select(*keep)


def ordered_index(df: DataFrame, keys: list[str], order: list[Column],
                  name: str = "idx", total: str | None = None) -> DataFrame:
    """Zero-based position of each row per key; the order must be unique."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    out = running_sums(ones, keys, order, ["_one"]).withColumn(name, F.col("cum__one") - 1)
    if total:
        out = out.withColumn(total, F.col("tot__one"))
    return out.drop("_one", "cum__one", "tot__one")


def _at_rank(cum: Column, n: Column, total: Column, value: Column, p: float) -> list[Column]:
    """Lower and upper neighbour of the interpolated rank (total - 1) * p."""
    rank = (total - 1) * F.lit(float(p))
    lower, upper = F.floor(rank), F.ceil(rank)
    here = lambda r: F.max(F.when((cum - n <= r) & (r < cum), value))
    return [here(lower), here(upper), F.max(rank - lower)]


def _interpolated(low: str, high: str, share: str) -> Column:
    """low + share * (high - low), exact at both ends."""
    return (
        F.when(F.col(low) == F.col(high), F.col(low))
        .otherwise(F.col(low) + (F.col(high) - F.col(low)) * F.col(share))
    )


def percentiles(df: DataFrame, keys: list[str], col: str, ps: dict[str, float],
                weight: str | None = None) -> DataFrame:
    """Exact interpolated percentiles per key, one output column per entry of ps; a
    weight column says how many rows each row stands for.

    Values are counted first, so no task ever holds the values of a whole group.
    """
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(*keys, F.col(col).alias("_v"))
        .agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    )
    ranked = running_sums(counts, keys, [F.col("_v")], ["_n"])
    aggs = []
    for name, p in ps.items():
        parts = _at_rank(F.col("cum__n"), F.col("_n"), F.col("tot__n"), F.col("_v"), p)
        aggs += [a.alias(f"_{name}_{i}") for i, a in enumerate(parts)]
    found = ranked.groupBy(*keys).agg(*aggs)
    return found.select(
        *keys, *[_interpolated(f"_{n}_0", f"_{n}_1", f"_{n}_2").alias(n) for n in ps]
    )


def lofo_medians(df: DataFrame, keys: list[str], fold: str, col: str, k: int,
                 name: str = "median") -> DataFrame:
    """Median of col over all folds but one, per key and left-out fold.

    One pass ranks the values once and carries a count per fold; leaving fold j
    out is then a subtraction, so no row is copied k - 1 times.
    """
    counts = (
        df.where(F.col(col).isNotNull() & F.col(fold).isNotNull())
        .groupBy(*keys, F.col(col).alias("_v"))
        .agg(
            F.count("*").alias("_n"),
            *[F.sum((F.col(fold) == j).cast("long")).alias(f"_f{j}") for j in range(k)],
        )
    )
    ranked = running_sums(counts, keys, [F.col("_v")], ["_n"] + [f"_f{j}" for j in range(k)])
    aggs = []
    for j in range(k):
        cum = F.col("cum__n") - F.col(f"cum__f{j}")
        n = F.col("_n") - F.col(f"_f{j}")
        total = F.col("tot__n") - F.col(f"tot__f{j}")
        parts = _at_rank(cum, n, total, F.col("_v"), 0.5)
        aggs += [a.alias(f"_{j}_{i}") for i, a in enumerate(parts)]
    found = ranked.groupBy(*keys).agg(*aggs)
    per_fold = F.array(*[
        F.struct(F.lit(j).alias(fold), _interpolated(f"_{j}_0", f"_{j}_1", f"_{j}_2").alias(name))
        for j in range(k)
    ])
    return found.select(*keys, F.explode(per_fold).alias("_r")).select(*keys, "_r.*")
