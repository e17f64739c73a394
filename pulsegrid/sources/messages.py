"""JSON messages of the broker path, and latency stamps."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from pulsegrid import schemas
from pulsegrid.functions import fixed_values as fv


def now_ms() -> Column:
    """Wall clock in ms; one value per batch, as current_timestamp is."""
    return F.unix_millis(F.current_timestamp())


def encode_events(df: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Canonical events to one JSON `value` column, with the producer's stamp."""
    stamped = df.select(
        "icustay_id", F.date_format("charttime", fv.TIME_FORMAT).alias("charttime"),
        "signal_name", "valuenum", "source_table",
        (now_ms() if stamp is None else stamp).alias("producer_timestamp_ms"),
    )
    return stamped.select(F.to_json(F.struct(*stamped.columns)).alias("value"))


def decode_events(df: DataFrame, schema: StructType = schemas.MESSAGE) -> DataFrame:
    """JSON `value` to typed columns; the time text becomes a timestamp."""
    parsed = df.select(F.from_json(F.col("value").cast("string"), schema).alias("_d")).select("_d.*")
    return parsed.withColumn(
        "charttime", F.try_to_timestamp("charttime", F.lit(fv.TIME_FORMAT))
    )


def with_latency(df: DataFrame, processed: Column | None = None) -> DataFrame:
    """Processing stamp and its distance to the producer stamp, in ms."""
    return df.withColumn(
        "processing_timestamp_ms", now_ms() if processed is None else processed
    ).withColumn("latency_ms", F.col("processing_timestamp_ms") - F.col("producer_timestamp_ms"))
