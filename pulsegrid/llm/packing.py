"""Packing by power-of-two decomposition (operator 4).

A document of n tokens becomes pieces of binary length: as many of `longest` as fit, then
one for each bit of the rest. Every piece is a sequence of its own in the bucket of its
length, so no sequence crosses documents and none needs padding.
"""

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import column_type, parted

# A sequence id holds the bucket, the task that made it, and its number there.
BUCKET_BITS, TASK_BITS, NUMBER_BITS = 6, 25, 32

# White space as the encoder's regex has it, and a run of it that is kept from that regex,
# which gives up when it has to step back over a million of them.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 100_000
_RUN = re.compile(f"(?<!{BLANK}){BLANK}{{{LONG_RUN},}}")


def binary_lengths(n: int, longest: int = 1024) -> list[int]:
    """Lengths of the pieces of n tokens, longest first.

    >>> binary_lengths(2053)
    [1024, 1024, 4, 1]
    """
    rest = n % longest
    bits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return [longest] * (n // longest) + bits


@lru_cache(maxsize=2)
def byte_encoder(ranks: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """The encoder of a rank file; strings of `special` in a text become their ids."""
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table,
                             special_tokens=dict(special))


def encode_text(encoder, text: str) -> list[int]:
    """Ids of a whole text, long runs of white space as the pattern would cut them.

    A run is one piece without its last character, which goes with what follows; at the end of the
    text or before a special string, none of which may hold white space, it is one piece.
    """
    if len(text) < LONG_RUN:
        return encoder.encode(text, allowed_special="all")
    ids: list[int] = []
    at, special = 0, tuple(encoder.special_tokens_set)
    for run in _RUN.finditer(text):
        start, end = run.span()
        if end < len(text) and not text.startswith(special, end):
            end -= 1
        ids += encoder.encode(text[at:start], allowed_special="all")
        ids += encoder._core_bpe.encode_single_piece(text[start:end].encode())
        at = end
    return ids + encoder.encode(text[at:], allowed_special="all")


def pack(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int] | None = None,
         longest: int = 1024, end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Cut every document, with `end_id` after its tokens, into sequences of binary length.

    `ranks` is a byte-level BPE rank file at a path that every executor has, `longest` a
    power of two. Returns one row per piece: id_col, start, length, bucket (log2 of the
    length), ids if wanted, ids_crc32, doc_tokens, sequence_id, offset (always 0); other
    columns are not kept.

    A null or empty text is the end id alone, a null id stays null, and repeated rows give
    repeated pieces in sequences of their own. No row leaves its task: a hot source, copies
    and very long texts make no difference. A sequence id is made of bucket, task and a
    running number, so it is the same whenever the input is read in the same splits.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    marks = tuple(sorted((special or {}).items()))
    names = ["id", "start", "length", "bucket", "ids_crc32", "doc_tokens", "sequence_id"]
    kinds = [pa.int64()] * 6

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(ranks, pattern, marks)
        task = TaskContext.get().partitionId()
        if task >> TASK_BITS:
            raise ValueError("too many tasks for a sequence id")
        made = [0] * longest.bit_length()
        for batch in parted(batches, 1):
            at: list[int] = []
            rows: list[tuple[int, ...]] = []
            ids_of: list[np.ndarray] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encode_text(encoder, text) if text else []
                ids.append(end_id)
                tokens = np.array(ids, dtype="<u4")
                start = 0
                for length in binary_lengths(len(ids), longest):
                    bucket = length.bit_length() - 1
                    piece = tokens[start:start + length]
                    number = (bucket << TASK_BITS | task) << NUMBER_BITS | made[bucket]
                    made[bucket] += 1
                    at.append(row)
                    rows.append((start, length, bucket, zlib.crc32(piece.tobytes()), len(ids), number))
                    if keep_ids:
                        ids_of.append(piece)
                    start += length
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)]
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *columns]
            if keep_ids:
                ends = np.cumsum([0, *map(len, ids_of)]).astype(np.int32)
                flat = np.concatenate(ids_of or [np.empty(0, "<u4")]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * keep_ids)

    schema = f"id {column_type(docs, id_col)}, " + ", ".join(f"{n} long" for n in names[1:])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cuts = rows.mapInArrow(cut, schema + ", ids array<int>" * keep_ids)
    return cuts.select(
        F.col("id").alias(id_col), "start", "length", "bucket", *["ids"] * keep_ids,
        "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store the sequences by bucket, so that a reader gets equal lengths together."""
    packed.write.partitionBy("bucket").parquet(path)
