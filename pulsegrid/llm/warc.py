"""Web archives with resolved revisits (operator 1).

Headers are shuffled by payload digest, revisits are joined to the response they repeat, and
the records are written again with fresh headers, a repeated payload only once.
"""

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CRLF = "\r\n"
END = "\r\n\r\n"  # ends the headers, and each record
VERSION = "WARC/1.1"


def _header(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))


def _clean(value: Column) -> Column:
    """A header value on one line; null becomes empty."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, payload (null: empty), payload_bytes, payload_digest."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )


def find_revisits(records: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Which records repeat another one: page_id, refers_to; one row per revisit's id.

    Only headers are shuffled. The smallest id of each digest is found with partial
    aggregates; the join of the many headers of one digest with that single row can be split
    by adaptive execution.
    """
    headers = records.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest")
    first = (headers.groupBy("payload_digest")
             .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
             .where("copies > 1 and refers_to is not null").drop("copies"))
    return (headers.join(first, "payload_digest")
            .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
            .select("page_id", "payload_digest", "refers_to").distinct())


def write_archives(records: DataFrame, revisits: DataFrame, path: str, date: str,
                   records_per_file: int = 5_000) -> None:
    """Write the records as gzipped archives through Spark's own committer.

    Each row is one record, and the line separator of the text writer is the end of a record,
    so the files are plain archives. A revisit has no block; it names the response and
    the full payload's length and digest.
    """
    known = revisits.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to")
    joined = records.join(
        known,
        F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")),
        "left",
    )
    revisit = F.col("_digest").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    ident = F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws("/", kind, F.col("page_id").cast("string"), "payload_digest"), 256), F.lit(">"))
    block = F.when(revisit, "").otherwise(F.col("payload"))
    header = F.concat(
        F.lit(VERSION + CRLF),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", ident),
        _header("WARC-Date", date),
        _header("WARC-Target-URI", _clean(F.col("url"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _header("X-Page-ID", _clean(F.col("page_id"))),
        F.when(revisit, F.concat(
            _header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            _header("X-Refers-To-Page-ID", _clean(F.col("refers_to"))),
            _header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        )).otherwise(""),
        _header("Content-Type", "text/html; charset=utf-8"),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(END),
    )
    (joined.select(F.concat(header, block).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, one at a time, cut by Content-Length alone."""
    while line := stream.readline():
        if line.strip() != VERSION.encode():
            raise ValueError(f"a record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            headers[name.decode().lower()] = value.decode()
        block = stream.read(int(headers["content-length"]))
        if stream.read(len(END)) != END.encode():
            raise ValueError(f"record {headers['warc-record-id']} is not ended")
        yield headers, block


READ_SCHEMA = ("page_id string, url string, record_type string, refers_to string, "
               "payload_bytes long, payload_digest string, block_matches boolean, payload string")


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of the archives below a path; the digest is taken anew from each block.

    `block_matches` tells whether it is the digest of the header. A revisit has a null
    payload, and the length and digest of the response's. The ids are text, "" for null.
    A file is decompressed as a stream; one record at a time is held.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows, held = [], 0
                for headers, block in parse_archive(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    stated = headers["warc-payload-digest"].removeprefix("sha256:")
                    if headers["warc-type"] == "response":
                        digest = hashlib.sha256(block).hexdigest()
                        length, refers = len(block), None
                        text = block.decode() if keep_payload else None
                    else:
                        digest, text = stated, None
                        length, refers = int(headers["x-payload-length"]), headers["x-refers-to-page-id"]
                    rows.append((headers["x-page-id"], headers["warc-target-uri"], headers["warc-type"],
                                 refers, length, digest, digest == stated, text))
                    held += len(block) * keep_payload + 200
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(read, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.string()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    names = [part.split()[0] for part in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def resolve(read: DataFrame) -> DataFrame:
    """Join each revisit to its response, by id and digest, and give it the full payload.

    Returns the records with the payload filled in, and `resolved`: false for a revisit whose
    response is not among them.
    """
    originals = read.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest",
        F.col("payload").alias("_original")).dropDuplicates(["refers_to", "payload_digest"])
    revisit = F.col("record_type") == "revisit"
    return (read.join(originals.withColumn("_found", F.lit(True)), ["refers_to", "payload_digest"], "left")
            .withColumn("payload", F.when(revisit, F.col("_original")).otherwise(F.col("payload")))
            .withColumn("resolved", ~revisit | F.coalesce("_found", F.lit(False)))
            .select(*read.columns, "resolved"))


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 100,
                  date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html") -> DataFrame:
    """Write the pages as archives below `path`, each payload once, and read them back.

    Of records with equal payloads of at least `least_bytes`, that with the smallest id is the
    response and the others revisit it; shorter payloads are all responses. Returns page_id,
    payload_bytes, payload_digest, record_type, refers_to; other columns are not kept.

    A null payload is empty. Rows that repeat an id and its payload share that row's fate: they are
    all responses or all revisits. Rows with a null id are revisits where a row with an
    id has the same payload, else responses. No pages: an empty result.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    records = records_of(pages, id_col, url_col, payload_col)
    write_archives(records, find_revisits(records, least_bytes), path, date)
    read = read_archives(spark, path, keep_payload=False)
    return read.select(
        F.when(F.col("page_id") != "", F.col("page_id")).cast(kind).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
