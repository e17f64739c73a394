"""Best-fit packing by a configuration linear program (operator 11).

Documents are counted by length. A configuration is a multiset of lengths that fits a sequence; the program
asks how often to use each configuration so that all lengths are covered by as few sequences as
possible. Multiplicative weights solve it: lengths that lag behind in cover weigh more, and a
knapsack dynamic program prices the next configuration. Amounts are rounded down; what they leave
is filled by the same dynamic program around the longest piece left.

The plan speaks of lengths alone, so its size does not grow with the documents. Each piece finds
its place in it by its rank among the pieces of its length.
"""

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm.arrow import column_type
from pulsegrid.session import stored

CANDIDATES = 192  # lengths that a knapsack chooses from
ROUNDS = 2_000  # of multiplicative weights
STEP = 0.5  # share of what is left of a length that a round may cover
RATE = 1.0  # weight of a length: exp(RATE * share not covered)
COVERED = 0.02  # a length is left to rounding from this share on
# Fixed value: ranks take so many bits beside the length.
RANK_BITS = 48
# ASCII and Latin letters that are one character each, whatever the normalisation, and have one small letter.
PLAIN = re.compile("[\x00-\x7f\u00c0-\u012f\u0131-\u017f]*").fullmatch
SMALL_LETTERS = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c.islower() and PLAIN(c))
# Words that a generation of a worker's memory holds, and their longest. It bounds memory only.
REMEMBERED, REMEMBERED_BYTES = 300_000, 48


class Pattern(NamedTuple):
    """`copies` sequences, each of `counts[k]` pieces of `lengths[k]` tokens, longest first."""

    copies: int
    lengths: tuple[int, ...]
    counts: tuple[int, ...]


# --- the plan -----------------------------------------------------------------------

def best_fill(lengths: np.ndarray, limits: np.ndarray, values: np.ndarray, room: int) -> np.ndarray:
    """How many of each length make the most value in `room`: a bounded knapsack.

    Limits are split into powers of two, each taken or not; a row of the table is one such
    choice at every room.

    >>> best_fill(np.array([5, 4, 3]), np.array([1, 1, 2]), np.array([5.0, 4.0, 3.0]), 11).tolist()
    [1, 0, 2]
    """
    bundles = []
    for k, (length, limit) in enumerate(zip(lengths.tolist(), limits.tolist())):
        limit, part = min(limit, room // length), 1
        while limit > 0:
            bundles.append((k, min(part, limit), min(part, limit) * length))
            limit -= part
            part *= 2
    best = np.zeros(room + 1)
    taken = np.zeros((len(bundles), room + 1), bool)
    for row, (k, times, size) in enumerate(bundles):
        with_it = best[:room + 1 - size] + times * values[k]
        np.greater(with_it, best[size:], out=taken[row, size:])
        np.maximum(with_it, best[size:], out=best[size:])
    counts = np.zeros(len(lengths), np.int64)
    for row in range(len(bundles) - 1, -1, -1):
        if taken[row, room]:
            k, times, size = bundles[row]
            counts[k] += times
            room -= size
    return counts


def fractional_cover(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS,
                     seed: int = 11) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Configurations (places among the lengths, counts) and how often to use each, not over any length's count.

    Each round prices one configuration: its value is its tokens, weighted by the share of each length
    not covered yet. It holds the piece of most value, as pieces that are hard to place must not be
    left to the end, and the best filling of the rest. It is used so often that no length in it loses more than STEP of what is
    left. A round looks at the CANDIDATES lengths that weigh most, ties and near ties
    in random order, so that short and long ones meet.
    """
    left = counts.astype(float)
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(rounds):
        share = left / counts
        lag = np.where(share > COVERED, share + draw.uniform(0, 0.3, len(share)), -1.0)
        pick = np.argsort(-lag, kind="stable")[:CANDIDATES]
        pick = np.sort(pick[lag[pick] > 0])
        if not len(pick):
            break
        value = lengths[pick] * np.exp(RATE * (share[pick] - share[pick].max()))
        first = int(value.argmax())
        limits = counts[pick]
        limits[first] -= 1
        config = best_fill(lengths[pick], limits, value, capacity - int(lengths[pick[first]]))
        config[first] += 1
        used = config > 0
        pick, config = pick[used], config[used]
        amount = STEP * float((left[pick] / config).min())
        left[pick] -= amount * config
        out.append((pick, config, amount))
    return out


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use every length just as often as it is there.

    Amounts of the linear program are rounded down. Then, as long as pieces are left, the longest one
    is joined by those that fill the rest of its sequence best, longer ones first
    among equals, as often as all of them are there.
    """
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    left = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    if len(lengths) and not 0 < lengths[-1] <= lengths[0] <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    used: dict[tuple, int] = {}

    def use(places: np.ndarray, config: np.ndarray, copies: int) -> None:
        key = tuple(lengths[places].tolist()), tuple(config.tolist())
        used[key] = used.get(key, 0) + copies
        left[places] -= copies * config

    counts = left.copy()
    for places, config, amount in fractional_cover(lengths, counts, capacity):
        if amount >= 1:
            use(places, config, int(amount))
    draw = np.random.default_rng(0)
    while left.any():
        first = int(np.flatnonzero(left)[0])
        room = capacity - int(lengths[first])
        rest = left.copy()
        rest[first] -= 1
        open_ = np.flatnonzero((rest > 0) & (lengths <= room))
        if len(open_) > CANDIDATES:
            open_ = np.sort(draw.choice(open_, CANDIDATES, replace=False))
        tokens = lengths[open_].astype(float)
        config = np.zeros(len(lengths), np.int64)
        config[open_] = best_fill(lengths[open_], rest[open_], tokens * (1 + 1e-4 * tokens / capacity), room)
        config[first] += 1
        places = np.flatnonzero(config)
        use(places, config[places], int((left[places] // config[places]).min()))
    return [Pattern(copies, *key) for key, copies in used.items()]


def place_table(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Which ranks of each length a pattern takes, and where its pieces lie.

    Arrays sorted by `key`, the length and the first rank: pieces per sequence, first sequence, first offset.
    """
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for copies, lengths, counts in patterns:
        offset = 0
        for length, count in zip(lengths, counts):
            rank = next_rank.get(length, 0)
            rows.append((length << RANK_BITS | rank, count, sequence, offset))
            next_rank[length] = rank + copies * count
            offset += length * count
        sequence += copies
    names = ["key", "count", "sequence", "offset"]
    return dict(zip(names, np.array(sorted(rows), np.int64).reshape(-1, 4).T))


# --- the tokens -----------------------------------------------------------------------

class Memory(dict):
    """Ids by word as they are asked for, in two generations.

    When the younger is full, the older is forgotten; what comes again moves back into the younger.
    """

    def __init__(self, find: Callable):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, word: bytes | str) -> bytes:
        found = self.older.get(word) or self.find(word)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


def byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds:
    """Little-endian 32-bit ids of whole texts, as bytes, piece by piece.

    For tokenizers that lower the text, drop white space and cut pieces by a pattern before they look them
    up. Texts of plain letters are cut here, as normalisation changes nothing but their case, and only
    the pieces go to the tokenizer's model. In other texts each word goes through the whole tokenizer: no
    piece reaches over a blank, so a word has the ids that it has in its text, special strings included.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as file:
            form = json.load(file)
        steps = [n["type"] for n in form["normalizer"]["normalizers"]]
        split, to_bytes = form["pre_tokenizer"]["pretokenizers"]
        if (steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]
                or split["behavior"] != "Removed" or to_bytes["type"] != "ByteLevel" or to_bytes["add_prefix_space"]):
            raise ValueError("a tokenizer of another kind")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t["content"] for t in form["added_tokens"])
        pattern = split["pattern"]["Regex"]
        for kind, chars in ((r"\p{L}", SMALL_LETTERS), (r"\p{N}", "0-9"), (r"\s", "\t-\r ")):
            pattern = pattern.replace(kind, chars)
        self.cut = re.compile(pattern).findall
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.words, self.pieces = Memory(self._word), Memory(self._piece)

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if PLAIN(text) and not any(mark in text for mark in self.special):
            pieces = self.pieces
            return b"".join([pieces[piece] for piece in self.cut(text.lower())])
        words = self.words
        return b"".join([words[word] for word in text.encode().split()])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memory of words per worker, which Spark uses for many tasks."""
    return WordIds(path)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, ids if wanted, and by `task` the `place` among equal lengths."""
    names = ["piece", "start", "length", "ids_crc32", "task", "place"]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode: Callable[[str], bytes] = word_ids(tokenizer)
        task, placed = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            at: list[int] = []
            rows: list[tuple[int, ...]] = []
            cuts: list[np.ndarray] = []
            for row, text in enumerate(batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + end)
                tokens = len(ids) // 4
                for piece, start in enumerate(range(0, tokens, capacity)):
                    length = min(capacity, tokens - start)
                    own = ids[4 * start:4 * (start + length)]
                    at.append(row)
                    rows.append((piece, start, length, zlib.crc32(own), task, placed[length]))
                    placed[length] += 1
                    if keep_ids:
                        cuts.append(np.frombuffer(own, "<i4"))
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows)) or [[]] * len(names)]
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *columns]
            if keep_ids:
                ends = np.cumsum([0, *map(len, cuts)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cuts or [np.empty(0, "<i4")]))))
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *names] + ["ids"] * keep_ids)

    schema = f"id {column_type(docs, id_col)}, " + ", ".join(f"{n} long" for n in names) + ", ids array<int>" * keep_ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, schema)


def pack_best_fit(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1,
                  keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document, with `end_id` after its tokens, into as few sequences as it can.

    `tokenizer` is a tokenizer file, at a path that every executor has, that drops white space. Longer
    documents are cut into pieces of `capacity`, the last may be shorter. Returns one row per
    piece: id_col, piece, start, length, ids if wanted, ids_crc32, sequence_id, offset; other
    columns are not kept. Sequences are gapless from 0 and hold whole pieces.

    A null or empty text is the end id alone, a null id stays null, and repeated rows are packed each;
    an empty table gives none. Pieces are numbered by length inside their task and written; a task's
    first rank of each length is a sum over the tasks before it. So neither a hot source nor a
    length that most documents have lands in one task: a window holds one row per task.
    The driver sees one count per length.
    """
    pieces = stored(cut_pieces(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = stored(by_task.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    histogram = {r["length"]: r["n"] for r in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = place_table(plan_sequences(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            row = np.searchsorted(places["key"], length << RANK_BITS | rank, "right") - 1
            turn = rank - (places["key"][row] & ((1 << RANK_BITS) - 1))
            sequence, slot = np.divmod(turn, places["count"][row])
            made = [places["sequence"][row] + sequence, places["offset"][row] + slot * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, made)], names=names)

    ranked = pieces.join(ranks.drop("n"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("place"))
    kept = ["id", "piece", "start", "length", *["ids"] * keep_ids, "ids_crc32"]
    names = [*kept, "sequence_id", "offset"]
    rows = ranked.select(*kept, "rank")
    schema = ", ".join(f"{n} {column_type(rows, n)}" for n in kept) + ", sequence_id long, offset long"
    return rows.mapInArrow(place, schema).withColumn("piece", F.col("piece").cast("int")).withColumnRenamed("id", id_col)
