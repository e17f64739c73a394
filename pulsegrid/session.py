"""Session settings, shared scratch space and size-checked broadcasts."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is only ever broadcast after it has been counted up to this many rows.
BROADCAST_ROWS = 500_000


def get_session(app: str = "pulsegrid", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by spark.checkpoint.dir.

    Only a local session may go without that setting: driver and executors
    share one machine there, so a temporary folder is enough.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="pulsegrid-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pulsegrid-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in this application's part of the shared folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once their readers are done."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def stored(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write a table to the shared folder, as Parquet, and go on from there.

    For tables that are read more than once: later reads prune columns and none
    repeats the work. It also cuts the lineage, and no lost executor takes the rows
    with it. `by` names a column of few values to lay the files out by: reads that filter on it
    open the files of its values alone.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path) if by else df.sparkSession.read.parquet(path)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state off the heap and save only its changes per batch; the
    processor API needs this store anyway."""
    state = "spark.sql.streaming.stateStore"
    spark.conf.set(
        f"{state}.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set(f"{state}.rocksdb.changelogCheckpointing.enabled", "true")


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint after a bounded count; larger sides stay shuffle joins."""
    small = df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
