"""Streaming sources, joins, sinks and monitoring."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pulsegrid import schemas
from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions.scalar import horizon_label
from pulsegrid.session import broadcast_if_small, scratch_path, use_rocksdb
from pulsegrid.sources.messages import decode_events, with_latency


def stream_files(spark: SparkSession, path: str, schema: StructType = schemas.EVENT,
                 fmt: str = "csv", pattern: str = "*.csv",
                 max_files: int | None = None) -> DataFrame:
    """Files of a folder as a stream.

    Files are taken in order of modification time; without `max_files` one drain
    reads them as one batch, so no event can come too late.
    """
    reader = (
        spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
    )
    if fmt == "csv":
        reader = reader.option("header", True).option("timestampFormat", fv.TIME_FORMAT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Decoded events of a topic with latency; needs the broker connector."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "earliest")
        .option("failOnDataLoss", "false").options(**options).load()
    )
    return with_latency(decode_events(raw))


def with_watermark(df: DataFrame, ts: str = "charttime",
                   delay: str = fv.WATERMARK_DELAY) -> DataFrame:
    """Watermark on an instant column; zone-less times are cast first."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay)


def attach_static(stream: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join to a static table, broadcast only after its rows were counted."""
    return stream.join(broadcast_if_small(dim), key, "left")


def attach_label(stream: DataFrame, cohort: DataFrame, key: str,
                 hours: int = fv.FIRST_HORIZON_HOURS) -> DataFrame:
    """Single-horizon label on streamed windows; `cohort` has one row per entity."""
    side = cohort.select(
        key, F.col("sepsis_label").alias("_pos"), F.col("sepsis_onset_time").alias("_onset")
    )
    joined = attach_static(stream, side, key)
    return joined.withColumn(
        "label", horizon_label("window_end_time", "_onset", hours, "_pos")
    ).drop("_pos", "_onset")


def checkpoint_for(spark: SparkSession, name: str) -> str:
    """A checkpoint folder of its own per source and purpose, outside any output."""
    return scratch_path(spark, f"checkpoint-{name}")


def sink_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, draining what exists now."""
    use_rocksdb(stream.sparkSession)
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def sink_batches(stream: DataFrame, batch_fn: Callable[[DataFrame, int], None],
                 checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to a function, draining what exists now."""
    use_rocksdb(stream.sparkSession)
    return (
        stream.writeStream.foreachBatch(batch_fn).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_available(query: StreamingQuery) -> None:
    """Wait until the bounded run is over; a failed run raises."""
    query.awaitTermination()


def multi_sink(writers: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """Several writers per micro-batch over rows computed once; empty batches are
    skipped."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                for writer in writers:
                    writer(batch, epoch)
        finally:
            batch.unpersist()

    return write


def parquet_by_epoch(path: str, drop: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer that replaces its own epoch folder, so a retried batch does not
    leave its rows twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.drop(*(drop or [])).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def latency_csv_by_epoch(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Latency rows of each window as CSV, one folder per epoch."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select(
            key, "window_end_time", "avg_latency_ms", "min_latency_ms", "max_latency_ms",
            "n_events", F.col("n_events").alias("throughput_per_window"),
        ).write.mode("overwrite").option("header", True).csv(f"{path}/epoch={epoch}")

    return write
