"""Filtering and code mapping of raw measurement events."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions import fixed_values as fv


def code_dimension(spark: SparkSession, kinds: list[str] | None = None) -> DataFrame:
    """The fixed code list as (itemid, signal_name, source_tag)."""
    rows = [
        (code, signal, kind)
        for signal, kind, codes in fv.SIGNAL_CODES
        if kinds is None or kind in kinds
        for code in codes
    ]
    return spark.createDataFrame(rows, "itemid int, signal_name string, source_tag string")


def bounds_dimension(spark: SparkSession, bounds=fv.PLAUSIBLE_RANGES) -> DataFrame:
    return spark.createDataFrame(list(bounds), "signal_name string, lo double, hi double")


def scan_codes(df: DataFrame, code: str, codes: list, cols: list[str]) -> DataFrame:
    """Keep wanted codes and columns; both reach the file scan."""
    return df.where(F.col(code).isin(list(codes))).select(*cols)


def keep_codes(df: DataFrame, code: str, codes: list) -> DataFrame:
    return df.where(F.col(code).isin(list(codes)))


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def map_codes(df: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """Inner join to a code dimension.

    The dimension is a fixed code list of a few dozen rows, so it is broadcast.
    """
    return df.join(F.broadcast(dimension), on)


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def incomplete_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in all, rows to be dropped, and nulls per column."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(bad).alias("n_dropped"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
    )


def apply_bounds(df: DataFrame, bounds: DataFrame, signal: str, value: str) -> DataFrame:
    """Drop values outside their signal's inclusive range; unlisted signals pass.

    `bounds` (signal, lo, hi) is a fixed list with one row per signal.
    """
    marked = df.join(F.broadcast(bounds), signal, "left")
    return marked.where(
        F.col("lo").isNull() | F.col(value).isNull() | F.col(value).between(F.col("lo"), F.col("hi"))
    ).drop("lo", "hi")


def bounds_report(df: DataFrame, bounds: DataFrame, signal: str, value: str) -> DataFrame:
    """Rows outside the range, per signal that has any."""
    return (
        df.join(F.broadcast(bounds), signal)
        .where(~F.col(value).between(F.col("lo"), F.col("hi")))
        .groupBy(signal, "lo", "hi").agg(F.count("*").alias("n_dropped"))
    )


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"))
