r"""Secret scanning with a password guess-cost search (operator 3).

Three fixed patterns find the base spans. Besides, the value in every credential context is
split at minimum cost into words, dates, repeats, keyboard walks and brute-force characters;
a value that costs at least `least_bits` bits to guess is a span of kind `guess`.
"""

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import column_type, parted

KINDS = ("assign", "access", "hex", "guess")

# The base patterns. A run of hex or access characters is never shorter for being
# asked to be long; an assigned value is checked after the match.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

# Names that announce a credential. `bearer` is also one with blanks alone behind it.
CONTEXT = re.compile(
    r"""(?i:(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|auth|private)[_-]?key|bearer|credentials?|login)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*|(?<![a-z])bearer[\x20\t]+)""",
    re.ASCII)
# Its value: in quotes up to the same quote, which a backslash escapes, or to the end of the line; else one bare word.
VALUE = re.compile(r""""((?:\\[^\r\n]|[^"\r\n])++)|'((?:\\[^\r\n]|[^'\r\n])++)|([^\s"'<>,;|]++)""")

# Words common in passwords and placeholders, by rank.
WORDS = """password admin welcome login letmein master dragon monkey shadow sunshine princess
football baseball superman batman iloveyou trustno hello freedom whatever secret token example
changeme default test guest root user pass access public private server database system manager
computer internet service backup temp demo sample dummy placeholder none null true false your
here key value name mail email home work love money summer winter spring autumn monday friday
january march april june july august october november december the and for with that this from
have not you are was all can has her his one our out day get him how man new now old see two way
who boy did its let put say she too use""".split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

_YEAR = r"(?:19|20)\d\d"
_DATE = re.compile(rf"\d{{1,2}}[-/._]\d{{1,2}}[-/._](?:{_YEAR}|\d\d)|{_YEAR}[-/._]\d{{1,2}}[-/._]\d{{1,2}}"
                   rf"|{_YEAR}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])|{_YEAR}")
_REPEAT = re.compile(r"(.)\1{2,}", re.DOTALL)
DATE_BITS = log2(365 * 130)
YEAR_BITS = log2(130)
SEGMENT_BITS = 1.0  # what it costs that another segment follows


@lru_cache(maxsize=1)
def _ranks() -> tuple[dict[str, float], int, frozenset[str]]:
    ranks = {}
    for rank, word in enumerate(WORDS):
        ranks.setdefault(word, log2(rank + 2))
    steps = {a + b for row in KEY_ROWS for a, b in zip(row, row[1:])}
    return ranks, max(map(len, ranks)), frozenset(steps | {s[::-1] for s in steps})


def _char_bits(char: str) -> float:
    if char.isdigit():
        return log2(10)
    if char.isalpha():
        return log2(26)
    return log2(33)


def guess_segments(value: str) -> list[tuple[int, int, str, float]]:
    """Every segment of the value that is not brute force: start, end, kind, bits.

    Words are substrings in the list, whatever their case (upper case costs a bit more);
    dates and years start anywhere; repeats and walks are the longest runs of at least three.
    """
    ranks, longest, steps = _ranks()
    lower = value.lower() if len(value.lower()) == len(value) else value
    found = []
    for start in range(len(value)):
        for end in range(start + 3, min(len(value), start + longest) + 1):
            bits = ranks.get(lower[start:end])
            if bits is not None:
                part = value[start:end]
                case = 0.0 if part == lower[start:end] else 1.0 if part.istitle() or part.isupper() else float(end - start)
                found.append((start, end, "word", bits + case))
        date = _DATE.match(value, start)
        if date:
            whole = date.end() - start > 4
            found.append((start, date.end(), "date", DATE_BITS if whole else YEAR_BITS))
    for run in _REPEAT.finditer(value):
        found.append((*run.span(), "repeat", _char_bits(run[1]) + log2(run.end() - run.start())))
    start = 0
    for at in range(1, len(value) + 1):
        if at == len(value) or lower[at - 1:at + 1] not in steps:
            if at - start >= 3:
                found.append((start, at, "walk", log2(47 * 2) + log2(at - start)))
            start = at
    return found


def guess_cost(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """Least bits to guess a value, and the segments that reach it.

    Dynamic programming over the ends: a segment costs its bits and SEGMENT_BITS; a brute-force
    character continues the brute-force segment before it. Linear in the value's length.
    """
    ending: dict[int, list[tuple[int, str, float]]] = {}
    for start, end, kind, bits in guess_segments(value):
        ending.setdefault(end, []).append((start, kind, bits))
    size = len(value)
    # Cheapest cover that ends in brute force, and in anything.
    brute, best = [float("inf")] * (size + 1), [0.0] * (size + 1)
    brute_from, best_from = [0] * (size + 1), [(0, "")] * (size + 1)
    for end in range(1, size + 1):
        bits = _char_bits(value[end - 1])
        opened, continued = best[end - 1] + SEGMENT_BITS + bits, brute[end - 1] + bits
        brute[end] = min(opened, continued)
        brute_from[end] = brute_from[end - 1] if continued <= opened else end - 1
        best[end], best_from[end] = brute[end], (brute_from[end], "brute")
        for start, kind, bits in ending.get(end, ()):
            if best[start] + SEGMENT_BITS + bits < best[end]:
                best[end], best_from[end] = best[start] + SEGMENT_BITS + bits, (start, kind)
    segments, end = [], size
    while end:
        start, kind = best_from[end]
        segments.append((start, end, kind))
        end = start
    return best[size], segments[::-1]


def guess_spans(text: str, least_bits: float) -> list[tuple[int, int, str]]:
    """Spans of the credential values that cost at least `least_bits`.

    Names are looked for in values that are too cheap as well: in `bearer token: x` both come before x.
    """
    spans, covered = [], 0
    for name in CONTEXT.finditer(text):
        value = VALUE.match(text, name.end()) if name.end() >= covered else None
        if value and guess_cost(value[value.lastindex])[0] >= least_bits:
            spans.append((*value.span(value.lastindex), "guess"))
            covered = value.end()
    return spans


def find_spans(text: str, least_bits: float) -> list[tuple[int, int, str]]:
    """All spans of a text, by start, then kind as listed; code points, end exclusive."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGNED]
    spans += guess_spans(text, least_bits)
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, least_bits: float = 36.0, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: id_col, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    Other columns are not kept. A null or empty text has no span (the digest is that of the
    empty text), a null id stays null, repeated rows stay repeated. No row leaves its task.
    """
    names = ["id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                spans = find_spans(text or "", least_bits)
                base = [s for s in spans if s[2] != "guess"]
                for column, kind in zip(columns, KINDS):
                    column.append(sum(s[2] == kind for s in spans))
                columns[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                columns[5].append(_joined(spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = (f"id {column_type(docs, id_col)}, n_assign long, n_access long, n_hex long, "
              "n_guess long, base_sha256 string, spans string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def redact(text: str, least_bits: float, mask: str) -> str:
    """The text with every secret, overlapping spans as one, replaced by the mask."""
    parts, at = [], 0
    for start, end, _ in find_spans(text, least_bits):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact_secrets(docs: DataFrame, least_bits: float = 36.0, mask: str = "[SECRET]",
                   text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with the secrets masked, and their new length.

    Texts without a secret, null ones included, stay as they are with all their columns.
    """

    def mask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, "text"):
            old = batch.column("text").to_pylist()
            new = [t and redact(t, least_bits, mask) for t in old]
            changed = [a != b for a, b in zip(old, new)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, pa.string()), pa.array(changed, pa.bool_()), batch.column("row")],
                names=["text", "changed", "row"])

    columns = docs.columns
    rows = docs.select(F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns if c != text_col)).alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()
    masked = rows.mapInArrow(mask_rows, f"text string, changed boolean, row {row_type}")
    out = []
    for c in columns:
        if c == text_col:
            out.append(F.col("text").alias(c))
        elif c == length_col:
            kind = docs.schema[c].dataType
            out.append(F.when(F.col("changed"), F.char_length("text").cast(kind)).otherwise(F.col(f"row.`{c}`")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return masked.select(*out)
