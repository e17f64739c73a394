"""Batch sinks."""

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import fixed_values as fv
from pulsegrid.operators.ordered import ordered_index


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append to a CSV folder; every part file carries the header."""
    df.write.mode("append").option("header", True).option(
        "timestampFormat", fv.TIME_FORMAT
    ).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A metrics document: one JSON row per row of the table."""
    df.write.mode("overwrite").json(path)


def split_ordered(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Add `chunk`: n near-equal consecutive runs in the given (unique) order, the
    last one takes the rest. With fewer rows than n, each row is its own chunk."""
    ranked = ordered_index(df, [], [F.col(c) for c in order], "_rn", total="_total")
    size = F.greatest(F.floor(F.col("_total") / n), F.lit(1))
    return ranked.withColumn(
        "chunk", F.least(F.floor(F.col("_rn") / size), F.lit(n - 1)).cast("int")
    ).drop("_rn", "_total")


def write_split(chunked: DataFrame, path: str, order: list[str]) -> None:
    """Write each chunk to its own folder, in order.

    Ranges on (chunk, order) rather than a hash of the chunk: a big chunk is
    written by several tasks, and no task holds it whole.
    """
    cols = ["chunk", *order]
    (
        chunked.repartitionByRange(*cols).sortWithinPartitions(*cols)
        .write.partitionBy("chunk").option("header", True)
        .option("timestampFormat", fv.TIME_FORMAT).csv(path)
    )


def split_manifest(chunked: DataFrame, ts: str) -> DataFrame:
    """Rows and time span per chunk."""
    return chunked.groupBy("chunk").agg(
        F.count("*").alias("row_count"), F.min(ts).alias("min_time"), F.max(ts).alias("max_time")
    )


def manifest_totals(chunked: DataFrame, ts: str, signal: str) -> DataFrame:
    """Rows, files, signals and span of the whole split."""
    per = chunked.groupBy("chunk", signal).agg(
        F.count("*").alias("_n"), F.min(ts).alias("_a"), F.max(ts).alias("_b")
    )
    return per.agg(
        F.sum("_n").alias("total_rows"), F.count_distinct("chunk").alias("n_files"),
        F.sort_array(F.collect_set(signal)).alias("signals"),
        F.min("_a").alias("min_time"), F.max("_b").alias("max_time"),
    )


def write_kafka(df: DataFrame, servers: str, topic: str, **options) -> None:
    """Write the `value` column to a topic; needs the broker connector on the class path."""
    writer = df.select("value").write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.option("topic", topic).options(**options).save()
