"""Fill-in-middle transformation over a piece table (operator 12).

A document is a row of descriptors (buffer, start, end) over two buffers that never change: its
text and the sentinels. Cutting splits descriptors, a form arranges them with sentinels between,
the inverse arrangement restores the text, and hashes run over the descriptors' spans. Characters
are copied only where a text is written out.
"""

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import column_type

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
TEXT, MARKS = 0, 1  # the buffers
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = range(3)
# Parts of a cut document: 0 prefix, 1 middle, 2 suffix. A form tells in which order marks and parts come.
LAYOUTS = {
    PSM: ((PREFIX_MARK, 0), (SUFFIX_MARK, 2), (MIDDLE_MARK, 1)),
    SPM: ((SUFFIX_MARK, 2), (PREFIX_MARK, 0), (MIDDLE_MARK, 1)),
}
HASHED_CHARS = 1_000_000  # a descriptor is encoded so many code points at a time
BATCH_CHARS = 8_000_000  # a batch goes out once it holds so many


class Descriptor(NamedTuple):
    buffer: int
    start: int
    end: int


class PieceTable:
    """Descriptors over a text and the sentinels.

    >>> table = PieceTable("abcdef", ("<P>", "<S>", "<M>"))
    >>> table.cut(2, 4)
    >>> table.arrange(PSM)
    >>> table.text()
    '<P>ab<S>ef<M>cd'
    """

    def __init__(self, text: str, marks: tuple[str, str, str]):
        self.buffers = (text, "".join(marks))
        ends = [sum(map(len, marks[:k + 1])) for k in range(3)]
        self.marks = [Descriptor(MARKS, end - len(mark), end) for mark, end in zip(marks, ends)]
        self.pieces = [Descriptor(TEXT, 0, len(text))]

    def cut(self, *places: int) -> None:
        """Split the descriptors at places of the text as they lay it out, in ascending order."""
        out, at, rest = [], 0, list(places)
        for buffer, start, end in self.pieces:
            size = end - start
            while rest and rest[0] <= at + size:
                place = start + rest.pop(0) - at
                out.append(Descriptor(buffer, start, place))
                at += place - start
                start, size = place, end - place
            out.append(Descriptor(buffer, start, end))
            at += size
        self.pieces = out

    def arrange(self, form: str) -> None:
        """Prefix, middle and suffix in the order of a form, with the sentinels before them."""
        parts = self.pieces
        self.pieces = [d for mark, part in LAYOUTS[form] for d in (self.marks[mark], parts[part])]

    def restore(self, form: str) -> None:
        """The inverse: find the sentinels in an arranged text, drop them, put the parts back in order."""
        text, places, at = self.buffers[TEXT], [], 0
        for mark, _ in LAYOUTS[form]:
            sentinel = self.buffers[MARKS][slice(*self.marks[mark][1:])]
            start = text.index(sentinel, at)
            at = start + len(sentinel)
            places += [start, at]
        if places[0] != 0:
            raise ValueError("an arranged text begins with a sentinel")
        self.cut(*places)
        parts = dict(zip((part for _, part in LAYOUTS[form]), self.pieces[2::2]))
        self.pieces = [parts[k] for k in range(3)]

    def spans(self, most: int | None = None) -> Iterator[str]:
        """The characters of the descriptors in order, at most so many at a time."""
        for buffer, start, end in self.pieces:
            held = self.buffers[buffer]
            step = most or max(end - start, 1)
            for at in range(start, end, step):
                yield held[at:min(at + step, end)]

    def text(self) -> str:
        return "".join(self.spans())

    def sha256(self) -> str:
        """Lower-case hex digest of the UTF-8 bytes, streamed over the descriptors."""
        digest = hashlib.sha256()
        for span in self.spans(HASHED_CHARS):
            digest.update(span.encode("utf-8", "surrogatepass"))
        return digest.hexdigest()


def check_marks(marks: tuple[str, str, str]) -> None:
    """Sentinels must be findable: no end of one may be the beginning of one, nor one inside another."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError("sentinels overlap")
    if len(set(marks)) != 3:
        raise ValueError("sentinels are equal")


def line_end(text: str, units: int, start: int = 0) -> int:
    """Where the line `units` lines after a place ends; the last one may lack its line feed."""
    at = start
    for _ in range(units):
        found = text.find("\n", at)
        if found < 0:
            return len(text)
        at = found + 1
    return at


def draws(seed: int, ident: object) -> list[int]:
    """Four unsigned 32-bit numbers out of the SHA-256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def transform_text(text: str, ident: object, seed: int, rate: int, spm_rate: int,
                   marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, PieceTable]:
    """Lines, form, lengths of prefix and middle (None if plain) and the arranged table of one text."""
    n = text.count("\n") + (bool(text) and text[-1] != "\n")
    table = PieceTable(text, marks)
    h1, h2, h3, h4 = draws(seed, ident)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, PLAIN, None, None, table
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    start = line_end(text, first)
    end = line_end(text, second - first, start)
    table.cut(start, end)
    form = SPM if h4 % 100 < spm_rate else PSM
    table.arrange(form)
    return n, form, start, end - start, table


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50,
                   marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Cut every text at line ends into prefix, middle and suffix, and arrange them with sentinels.

    Returns id_col, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain),
    output (the arranged text) and output_sha256; other columns are not kept. `rate` and `spm_rate`
    are per cent of texts to arrange, and of those in spm form; they and the cuts depend on
    seed and id alone, so reruns agree.

    A null text is the empty one. Empty texts and those that hold a sentinel stay plain. A null
    id draws like the empty string. Repeated rows give repeated rows; an empty table an empty
    one. No row leaves its task, so copies and hot sources make no difference; memory is a small multiple of
    the longest text.
    """
    check_marks(marks)

    def arrange(ident: object, text: str) -> tuple:
        n, form, before, middle, table = transform_text(text, ident, seed, rate, spm_rate, marks)
        return n, form, before, middle, table.text(), table.sha256()

    made = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long",
            "output": "string", "output_sha256": "string"}
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).alias("ident"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _with_columns(rows, 1, arrange, made).withColumnRenamed("id", id_col)


def restore_middle(arranged: DataFrame, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
                   form_col: str = "form", output_col: str = "output") -> DataFrame:
    """The inverse of `fill_in_middle`: its rows with text and restored_sha256 in place of the output.

    Needs the arranged text and its form alone; a null form is plain, a null text empty. A text
    that its form does not fit ends the job. Repeated rows stay repeated.
    """
    check_marks(marks)
    keep = [c for c in arranged.columns if c not in (output_col, "text", "restored_sha256")]

    def rebuild(form: str, output: str) -> tuple:
        table = PieceTable(output, marks)
        if form != PLAIN:
            table.restore(form)
        return table.text(), table.sha256()

    # named by place, so that columns of any name can come along
    rows = arranged.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                           F.coalesce(form_col, F.lit(PLAIN)).alias("form"),
                           F.coalesce(output_col, F.lit("")).alias("output"))
    rebuilt = _with_columns(rows, len(keep), rebuild, {"text": "string", "restored_sha256": "string"})
    return rebuilt.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "restored_sha256")


def _with_columns(rows: DataFrame, keep: int, function: Callable, made: dict[str, str]) -> DataFrame:
    """The first `keep` columns and what a function makes of the values of the others, row by row.

    A batch goes out as soon as it holds BATCH_CHARS of text, so long texts do not add up.
    """
    kinds = [{"long": pa.int64(), "string": pa.string()}[kind] for kind in made.values()]
    names = rows.columns[:keep] + list(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple] = []
            first = held = 0
            for row in range(batch.num_rows):
                done.append(function(*(column[row].as_py() for column in batch.columns[keep:])))
                held += sum(len(value) for value in done[-1] if isinstance(value, str))
                if held >= BATCH_CHARS or row == batch.num_rows - 1:
                    kept = [column.slice(first, len(done)) for column in batch.columns[:keep]]
                    new = [pa.array(values, kind) for values, kind in zip(zip(*done), kinds)]
                    yield pa.RecordBatch.from_arrays(kept + new, names=names)
                    done, first, held = [], row + 1, 0

    schema = [f"{name} {column_type(rows, name)}" for name in rows.columns[:keep]]
    return rows.mapInArrow(run, ", ".join(schema + [f"{name} {kind}" for name, kind in made.items()]))
