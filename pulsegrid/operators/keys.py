"""Comparing key sets and matched rows of two tables."""

from pyspark.sql import DataFrame, Window, functions as F


def dedupe(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def key_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys only in a and keys only in b, from one aggregation of both."""
    sides = (
        a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionAll(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    return sides.where("_a <> _b").select(
        *keys, F.when(F.col("_a") == 1, "only_a").otherwise("only_b").alias("side")
    )


def overlap_funnel(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys a has, b has, and both have."""
    sides = (
        a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionAll(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    return sides.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("n_b"),
        F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("n_both"),
    )


def merge_scores(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys)


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], col_a: str, col_b: str) -> DataFrame:
    """Matched rows whose values differ, nulls compared as values."""
    return a.join(b, keys).where(~F.col(col_a).eqNullSafe(F.col(col_b)))


def reconcile_counts(a: DataFrame, b: DataFrame, keys: list[str], col_a: str, col_b: str) -> DataFrame:
    """Matched rows, differing rows and the direction of the difference."""
    return a.join(b, keys).agg(
        F.count("*").alias("n_matched"),
        F.count_if(~F.col(col_a).eqNullSafe(F.col(col_b))).alias("n_differ"),
        F.count_if((F.col(col_a) == 0) & (F.col(col_b) == 1)).alias("n_a0_b1"),
        F.count_if((F.col(col_a) == 1) & (F.col(col_b) == 0)).alias("n_a1_b0"),
    )


def sample_per_group(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first k rows per group by the order.

    A row number with an upper limit lets Spark keep only k rows per group in
    each partition before it shuffles, so a large group costs no more than k
    rows per partition.
    """
    number = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_r", number).where(F.col("_r") <= k).drop("_r")
