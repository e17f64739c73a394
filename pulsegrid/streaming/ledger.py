"""Appending each micro-batch once, and replaying ordered chunks.

A micro-batch whose run dies is given out again under its epoch. Its rows are staged, moved into
place by one rename, and noted in a ledger; a batch that finds its epoch in the ledger, or its rows in
place, adds nothing.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pulsegrid.functions import fixed_values as fv


class Folder:
    """A folder in any file system that Spark can write to, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(self.at(name)))

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(self.at(name)), self._path(self.at(to))):
            raise OSError(f"could not move {name} to {to} in {self.root}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.at(name))))

    def set_time(self, name: str, millis: int) -> None:
        self._fs.setTimes(self._path(self.at(name)), millis, -1)


LEDGER, STAGED = "_ledger", "_staged"


def append_once(path: str, write: Callable[[DataFrame, str, bool], None]) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds the rows of an epoch to a folder exactly once.

    `write(batch, folder, first)` writes the rows; `first` is True until an epoch is in place. Epochs lie in
    folders epoch-<number>; the names beginning with _ are not read by Spark.
    """

    def once(batch: DataFrame, epoch: int) -> None:
        folder = Folder(batch.sparkSession, path)
        own = f"epoch-{epoch:012d}"
        if folder.exists(f"{LEDGER}/{own}"):
            return
        if not folder.exists(own):  # else it died between the move and the note
            staged = f"{STAGED}/{own}-{uuid.uuid4().hex}"
            folder.make(STAGED)
            first = not any(n.startswith("epoch-") for n in folder.names())
            write(batch, folder.at(staged), first)
            folder.move(staged, own)
        folder.make(f"{LEDGER}/{own}")

    return once


def append_csv_once(path: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """Rows of each epoch appended to a CSV log, once, with one header at its very beginning: the files
    in order of their paths make one CSV file."""

    def write(batch: DataFrame, folder: str, first: bool) -> None:
        rows = batch.select(*columns)
        cells = rows.select(F.to_csv(F.struct(*columns), {"timestampFormat": fv.TIME_FORMAT}).alias("value"))
        if not first:
            cells.write.text(folder)
            return
        # the header goes first, into a file of its own
        header = batch.sparkSession.createDataFrame([(",".join(columns),)], "value string").coalesce(1)
        header.write.text(f"{folder}/0-header")
        cells.write.text(f"{folder}/1-rows")

    return append_once(path, write)


def read_csv_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a log that `append_csv_once` wrote; an empty or missing log has none."""
    if not any(n.startswith("epoch-") for n in Folder(spark, path).names()):
        return spark.createDataFrame([], schema)
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    rows = lines.where(F.col("value") != ",".join(schema.names))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return rows.select(F.from_csv("value", kinds, {"timestampFormat": fv.TIME_FORMAT}).alias("_r")).select("_r.*")


def commit_chunks(chunked: DataFrame, path: str, order: list[str], chunk: str = "chunk",
                  seconds_apart: int = 1, after: Callable[[], None] | None = None) -> int:
    """Write the chunks of a split as Parquet so that a file stream replays them in their order.

    All chunks are written at once, by ranges of (chunk, order), to a staging folder. Then each chunk
    is moved into place in turn, its files dated one after another up to now, which is the order
    in which a file source takes them; `after` is called after each chunk. Returns the number of files.
    The file system must let file times be set, as HDFS and local ones do.
    """
    spark = chunked.sparkSession
    folder = Folder(spark, path)
    cols = [chunk, *order]
    staged = f"{STAGED}/{uuid.uuid4().hex}"
    (chunked.repartitionByRange(*cols).sortWithinPartitions(*cols)
     .write.partitionBy(chunk).parquet(folder.at(staged)))
    chunks = sorted((n for n in folder.names(staged) if n.startswith(f"{chunk}=")), key=lambda n: int(n.split("=")[1]))
    files = [(c, f) for c in chunks for f in folder.names(f"{staged}/{c}") if f.startswith("part-")]
    now = int(spark.range(1).select(F.unix_millis(F.current_timestamp())).first()[0])
    for place, (c, f) in enumerate(files):
        folder.set_time(f"{staged}/{c}/{f}", now - (len(files) - place) * seconds_apart * 1000)
    for c in chunks:
        # no key=value name, so that files alone make the rows
        folder.move(f"{staged}/{c}", f"{chunk}-{int(c.split('=')[1]):09d}")
        if after:
            after()
    folder.delete(staged)
    return len(files)
