"""Batch scans with declared schemas."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pulsegrid import schemas
from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions.scalar import from_ntz


def read_csv_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header and a declared schema; unreadable values become null and a
    missing path is an error."""
    return (
        spark.read.schema(schema).option("header", True)
        .option("timestampFormat", f"[{fv.TIME_FORMAT}][yyyy-MM-dd]")
        .csv(path)
    )


def read_events(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Canonical event files."""
    return (
        spark.read.schema(schemas.EVENT).option("header", True)
        .option("timestampFormat", fv.TIME_FORMAT).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).csv(path)
    )


def read_windows(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    """A window sink; chosen columns reach the file scan. Zone-less times become
    instants of the UTC session."""
    df = spark.read.parquet(path)
    return from_ntz(df.select(*cols) if cols else df)


def read_cohort(spark: SparkSession, path: str, key: str = "icustay_id") -> DataFrame:
    return from_ntz(spark.read.parquet(path).select(key, "sepsis_label", "sepsis_onset_time"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables, times cast to instants."""
    return from_ntz(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def is_empty(df: DataFrame) -> bool:
    return df.select(F.lit(1)).isEmpty()
