"""Document fingerprints as invertible Bloom lookup sketches (operator 5).

A text's paragraphs are hashed into the cells of a small table. Two tables subtract cell by cell,
what both texts share cancels, and peeling recovers the digests of the paragraphs that
differ; where that fails, larger tables are made and subtracted again.
"""

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import column_type

# A paragraph ends with a line or a sentence; one without either is cut every 200 characters, so
# that an edit further on leaves the earlier ones as they are.
PARAGRAPH = re.compile(r"[^\n.!?]{1,200}[\n.!?]*|[\n.!?]+")
CELLS = 24  # of a fingerprint; a retry has GROWTH times as many
GROWTH = 4
WAYS = 3  # cells of a digest, one in each third of the table
_ODD = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * _ODD & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def digests(text: str) -> np.ndarray:
    """64-bit digests of a text's paragraphs; a repeated paragraph counts with its number."""
    hashes = [xxhash.xxh3_64_intdigest(p) for p in PARAGRAPH.findall(text)]
    if len(set(hashes)) < len(hashes):
        times: dict[int, int] = {}
        for at, h in enumerate(hashes):
            times[h] = n = times.get(h, 0) + 1
            if n > 1:
                hashes[at] = xxhash.xxh3_64_intdigest(h.to_bytes(8, "little"), seed=n)
    return np.array(hashes, np.uint64)


@dataclass
class Sketches:
    """Tables of several texts, one after another, of `cells` cells each."""

    cells: int
    count: np.ndarray
    keys: np.ndarray
    checks: np.ndarray

    @classmethod
    def empty(cls, rows: int, cells: int) -> "Sketches":
        size = rows * cells
        return cls(cells, np.zeros(size, np.int32), np.zeros(size, np.uint64), np.zeros(size, np.uint64))

    def add(self, rows: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        third = np.uint64(self.cells // WAYS)
        check = _mix(keys, 77)
        for way in range(WAYS):
            at = rows * self.cells + way * int(third) + (_mix(keys, way + 1) % third).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)

    @classmethod
    def of(cls, parts: list[np.ndarray], cells: int) -> "Sketches":
        made = cls.empty(len(parts), cells)
        if parts:
            rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            made.add(rows, np.concatenate(parts), 1)
        return made

    def minus(self, other: "Sketches") -> "Sketches":
        return Sketches(self.cells, self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Recovered rows and digests, and the rows whose table did not empty."""
        rows_out, keys_out = [], []
        while True:
            pure = np.flatnonzero((np.abs(self.count) == 1) & (_mix(self.keys, 77) == self.checks))
            if not len(pure):
                break
            found = np.unique(np.stack([(pure // self.cells).astype(np.uint64), self.keys[pure],
                                        self.count[pure].astype(np.int64).view(np.uint64)], 1), axis=0)
            rows, keys = found[:, 0].astype(np.int64), found[:, 1]
            self.add(rows, keys, -found[:, 2].copy().view(np.int64).astype(np.int32))
            rows_out.append(rows)
            keys_out.append(keys)
        left = np.flatnonzero((self.count != 0) | (self.keys != 0))
        none = np.empty(0, np.int64)
        return (np.concatenate(rows_out or [none]), np.concatenate(keys_out or [none.astype(np.uint64)]),
                np.unique(left // self.cells))

    def text(self, row: int) -> str:
        """A fingerprint: count, key and check of each cell, in base 64."""
        own = slice(row * self.cells, (row + 1) * self.cells)
        return base64.b64encode(
            self.count[own].astype("<u2").tobytes() + self.keys[own].astype("<u8").tobytes()
            + self.checks[own].astype("<u4").tobytes()).decode()


def differing(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and digests in which each a[i] and b[i] differ, recovered from their sketches.

    Rows that do not peel try again with GROWTH times the cells. A table of many times more cells
    than digests only fails if two digests share all their cells; those rows, and only
    those, compare the digests themselves.
    """
    todo = np.arange(len(a))
    rows_out, keys_out = [], []
    while len(todo):
        own_a, own_b = [a[i] for i in todo], [b[i] for i in todo]
        rows, keys, failed = Sketches.of(own_a, cells).minus(Sketches.of(own_b, cells)).peel()
        good = ~np.isin(rows, failed)
        rows_out.append(todo[rows[good]])
        keys_out.append(keys[good])
        todo = todo[failed]
        cells *= GROWTH
        stuck = np.array([cells > 256 * (len(a[i]) + len(b[i]) + 8) for i in todo], bool)
        for i in todo[stuck]:
            other = np.setxor1d(a[i], b[i])
            rows_out.append(np.full(len(other), i))
            keys_out.append(other)
        todo = todo[~stuck]
    if not rows_out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(keys_out)


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard likeness of the digests, from what the sketches' difference recovers."""
    rows, _ = differing(a, b)
    apart = np.bincount(rows, minlength=len(a))
    both = np.array([len(x) for x in a]) + np.array([len(x) for x in b])
    return np.where(both > 0, (both - apart) / np.maximum(both + apart, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the start of the following one."""
    part = len(text) // 4
    return text[:len(text) - part] + following[:part]


NAMES = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compare(ids: list, values: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    """All but the last text, each with the one after it."""
    edited = [edited_text(t, n) for t, n in zip(values, values[1:])]
    own, changed = [digests(t) for t in values], [digests(t) for t in edited]
    prints, edited_prints = Sketches.of(own[:-1], CELLS), Sketches.of(changed, CELLS)
    columns = [
        pa.array(ids[:-1], id_type), pa.array([len(t) for t in values[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        pa.array([prints.text(i) for i in range(len(edited))], pa.string()),
        pa.array([edited_prints.text(i) for i in range(len(edited))], pa.string()),
        pa.array(likeness(own[:-1], changed), pa.float64()), pa.array(likeness(own[:-1], own[1:]), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=list(NAMES))


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         rows_per_range: int = 1_000, most_ranges: int = 20_000) -> DataFrame:
    """Fingerprint every whole text and its edited version, and compare neighbours.

    The order is (id, text), null ids first; after the last row comes the first. Returns
    id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; other
    columns are not kept. Null and empty texts have no paragraphs; two such are wholly alike. Rows
    that repeat an id follow each other. The id is an integer.

    Rows are dealt to ranges of ids. The first row of each range also goes to the range before
    it, so every text is shuffled once and a task streams through its ranges in order. What
    the driver holds is one bound and one first id per range, most_ranges at most.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    total = ids.count()
    ranges = max(1, min(total // rows_per_range, most_ranges))
    cuts = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))
                   .alias("cuts")).first()["cuts"] if ranges > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    def place(values: pa.Array) -> np.ndarray:
        """Range of each id; a null one is in the first."""
        known = np.array(values.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        found = np.searchsorted(bounds, known, side="right")
        found[np.array(values.is_null().to_numpy(zero_copy_only=False), bool)] = 0
        return found

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(place(batch.column(0)), pa.int64()), batch.column(0)], names=["range", "id"])

    heads = (ids.mapInArrow(ranged, "range long, id long").groupBy("range")
             .agg(F.when(F.max(F.col("id").isNull()), F.lit(None)).otherwise(F.min("id")).alias("id"))
             .orderBy("range").collect())
    before = {h["id"]: heads[i - 1]["range"] for i, h in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = place(batch.column(0))
            values = batch.column(0).to_pylist()
            first = [i for i, v in enumerate(values) if v in before]
            at = np.concatenate([np.arange(len(values)), np.array(first, np.int64)])
            to = np.concatenate([own, np.array([before[values[i]] for i in first], np.int64)])
            look = np.arange(len(at)) >= len(values)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int64()), pa.array(look, pa.bool_()), *taken.columns], names=["range", "look", "id", "text"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_ids, held, chars, ended = None, [], [], 0, True
        for batch in batches:
            for at, look, ident, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now:
                    now, held_ids, held, chars, ended = at, [], [], 0, False
                if ended:
                    continue  # another row with the following range's first id
                held_ids.append(ident)
                held.append(text or "")
                chars += len(held[-1])
                ended = look
                if len(held) > 1 and (look or chars > 2_000_000 or len(held) > 2_000):
                    yield _compare(held_ids, held, pa.int64())
                    held_ids, held, chars = held_ids[-1:], held[-1:], len(held[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = (rows.mapInArrow(deal, "range long, look boolean, id long, text string")
             .repartition("range").sortWithinPartitions("range", "look", "id", "text"))
    out = dealt.mapInArrow(read, (
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"))
    return out.select(F.col("id").cast(column_type(docs, id_col)).alias(id_col), *NAMES[1:])
