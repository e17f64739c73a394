"""Progress of streaming queries, kept as a table."""

import threading
import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = ("event string, query string, run string, batch bigint, n_input bigint, rows_per_second double, "
          "n_dropped bigint, n_state bigint, watermark string, at timestamp")


class ProgressTable(StreamingQueryListener):
    """Writes start, progress and end of the session's queries to a Parquet folder.

    At most `most` rows wait on the driver; they are appended when that many have come, when a query ends
    and on `flush`. `n_dropped` sums numRowsDroppedByWatermark over the stateful operators of a batch.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 100):
        self.spark, self.path, self.most = spark, path, most
        self._waiting: list[tuple] = []
        self.told = 0
        self._lock = threading.Lock()

    def _add(self, *row) -> None:
        with self._lock:
            self._waiting.append(row)
            full = len(self._waiting) >= self.most
        if full or row[0] == "terminated":
            self.flush()
        self.told += row[0] == "terminated"

    def settle(self, queries: int, seconds: float = 30.0) -> None:
        """Wait until the ends of so many queries have been told, as events come late; then write what waits."""
        end = time.monotonic() + seconds
        while time.monotonic() < end and self.told < queries:
            time.sleep(0.05)
        self.flush()

    def __enter__(self) -> "ProgressTable":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def flush(self) -> None:
        with self._lock:
            rows, self._waiting = self._waiting, []
        if rows:
            made = self.spark.createDataFrame(rows, SCHEMA.replace(", at timestamp", "")).coalesce(1)
            made.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event):
        self._add("started", str(event.id), str(event.runId), None, None, None, None, None, None)

    def onQueryProgress(self, event):
        p = event.progress
        self._add("progress", str(p.id), str(p.runId), p.batchId, p.numInputRows, p.processedRowsPerSecond,
                  sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
                  sum(s.numRowsTotal for s in p.stateOperators), (p.eventTime or {}).get("watermark"))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._add("terminated", str(event.id), str(event.runId), None, None, None, None, None, None)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def late_rows(progress: DataFrame) -> DataFrame:
    """Rows that came in and rows dropped as too late, per micro-batch with rows."""
    return progress.where("event = 'progress' AND n_input > 0").groupBy("query", "batch").agg(
        F.max("n_input").alias("n_rows"), F.max("n_dropped").alias("n_late"))
