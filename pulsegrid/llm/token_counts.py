"""Token counts by byte-pair merging with a heap and a linked list (operator 10).

The count is the number of initial symbols minus the number of merges; no identifier is
looked up. Symbols that are not in the vocabulary count one token per UTF-8 byte.
"""

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import column_type

SPACE = "▁"  # stands for a blank in piece vocabularies
NORMAL = 1
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
# Words whose count a worker remembers; beyond it forgets them all. It bounds memory only.
REMEMBERED = 600_000


def count_pieces(text: str, ranks: dict[str, float]) -> int:
    """Tokens of one piece of text: pop the best adjacent pair until none is left.

    `ranks` orders the pieces, lowest first; the left one of equal pairs goes first.
    """
    size = len(text)
    symbols: list[str | None] = list(text)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = []
    for left in range(size - 1):
        joined = text[left:left + 2]
        if joined in ranks:
            heap.append((ranks[joined], left, joined))
    heapify(heap)
    merges = 0
    while heap:
        _, left, joined = heappop(heap)
        if symbols[left] is None or (right := after[left]) == size:
            continue
        if symbols[left] + symbols[right] != joined:
            continue  # one of the two has been merged meanwhile
        merges += 1
        symbols[left], symbols[right] = joined, None
        after[left] = after[right]
        if after[left] < size:
            before[after[left]] = left
            longer = joined + symbols[after[left]]
            if longer in ranks:
                heappush(heap, (ranks[longer], left, longer))
        if before[left] >= 0:
            longer = symbols[before[left]] + joined
            if longer in ranks:
                heappush(heap, (ranks[longer], before[left], longer))
    unknown = sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in ranks)
    return size - merges + unknown


@lru_cache(maxsize=2)
def piece_ranks(model: str) -> dict[str, float]:
    """Rank of every ordinary piece of a sentencepiece model: the negated score."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as file:
        proto.ParseFromString(file.read())
    return {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}


class PieceCounter:
    """Counts tokens of whole texts, word by word.

    No piece holds a blank after another character, nor a line feed, so no merge crosses
    the start of a word or of a line: words are counted apart and remembered.
    """

    def __init__(self, model: str):
        self.ranks = piece_ranks(model)
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ranks):
            raise ValueError("pieces of this vocabulary cross words or lines")
        self.seen: dict[str, int] = {}

    def _count(self, segment: str) -> int:
        found = self.seen.get(segment)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.seen[segment] = count_pieces(segment, self.ranks)
        return found

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        lines = (SPACE + text.replace(" ", SPACE)).split("\n")
        total, seen, count = len(lines) - 1, self.seen, self._count
        for line in lines:
            for segment in SEGMENT.findall(line):
                total += seen.get(segment) or count(segment)
        return total


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, and whether it is over the limit.

    Returns id_col, n_bytes, n_tokens, over_limit; other columns are not kept. A null or
    empty text has 0 tokens, repeated rows stay repeated, and a null id stays null. `model`
    is a sentencepiece BPE model with byte fallback at a path that every executor has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Callable[[str], int] = PieceCounter(model)
        for batch in batches:
            counts = [counter(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    schema = f"id {column_type(docs, id_col)}, n_bytes long, n_tokens long"
    return rows.mapInArrow(count, schema).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
