r"""Chat formatting with a grammar round trip (operator 2).

Grammar of a formatted conversation, read from left to right without looking back:

    conversation = turn*
    turn         = "### " role ": " body NEWLINE "</turn>" NEWLINE
    role         = (any character but ":" and "\" | "\" any character)*
    body         = text in which no control string stands bare

The control strings are "### " and "</turn>". A run of n >= 1 backslashes before one of them
reads as n - 1 backslashes and the string itself; elsewhere a backslash is a backslash.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import column_type

OPEN, CLOSE = "### ", "</turn>"
CONTROLS = (OPEN, CLOSE)
ENDING = f"\n{CLOSE}\n"
_CONTROL = re.compile(rf"(\\*)({re.escape(OPEN)}|{re.escape(CLOSE)})")
_ROLE = re.compile(r"(?:[^:\\]|\\.)*", re.DOTALL)


class Conflict(ValueError):
    """The parser met a control string where the grammar has none."""


def parse_turn(block: str, start: int = 0) -> tuple[str, str, slice, int]:
    """Role, text, the body's place, and where the next turn starts."""
    if not block.startswith(OPEN, start):
        raise Conflict(f"no turn at {start}")
    role = _ROLE.match(block, start + len(OPEN))
    if not block.startswith(": ", role.end()):
        raise Conflict(f"no role at {start}")
    body = role.end() + 2
    parts, at = [], body
    for found in _CONTROL.finditer(block, body):
        slashes, control = found.groups()
        if slashes:
            parts += [block[at:found.start()], slashes[1:], control]
            at = found.end()
        elif control == CLOSE and found.start() > body and block[found.start() - 1] == "\n":
            parts.append(block[at:found.start() - 1])
            if not block.startswith(ENDING, found.start() - 1):
                raise Conflict(f"no end of line after {found.start()}")
            return (re.sub(r"\\(.)", r"\1", role.group(), flags=re.DOTALL), "".join(parts),
                    slice(body, found.start() - 1), found.end() + 1)
        else:
            raise Conflict(f"{control!r} at {found.start()}")
    raise Conflict(f"turn at {start} has no end")


def _escaped(text: str, controls: list[str]) -> str:
    for control in controls:
        text = text.replace(control, "\\" + control)
    return text


def format_turn(role: str, text: str) -> tuple[str, slice]:
    """A turn that parses back to exactly this role and text, and its body's place.

    It is rendered as it is, parsed again and compared. As long as the parser recovers
    anything else, the text's next control string is escaped and the turn rendered anew;
    with all of them escaped the two are always identical.
    """
    name = re.sub(r"([:\\])", r"\\\1", role)
    pending = [c for c in CONTROLS if c in text]
    escaped: list[str] = []
    while True:
        block = f"{OPEN}{name}: {_escaped(text, escaped)}{ENDING}"
        try:
            again, recovered, body, end = parse_turn(block)
            if (again, recovered, end) == (role, text, len(block)):
                return block, body
        except Conflict:
            pass
        escaped.append(pending.pop(0))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text",
                 loss_role: str = "assistant") -> DataFrame:
    """Format every turn; a conversation is its blocks one after another, in turn order.

    Returns conv_id, turn, role, text (the source, for order among equal turn numbers), block,
    loss_start, loss_end: code points in the block that the loss covers, null for other roles.
    Null roles and texts are empty. A turn is formatted where it is read, so a
    conversation of any length is never held whole.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, starts, ends = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                block, body = format_turn(role, text)
                blocks.append(block)
                starts.append(body.start if role == loss_role else None)
                ends.append(body.stop if role == loss_role else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(blocks, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["conv_id", "turn", "block", "loss_start", "loss_end"])

    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(render, (
        f"conv_id {column_type(turns, conv_col)}, turn {column_type(turns, turn_col)}, "
        "block string, loss_start long, loss_end long"))


class _Digest:
    """What is read back from one conversation, block after block."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns = self.loss = self.formatted = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, block: str, loss: slice | None) -> None:
        at = 0
        while at < len(block):
            role, text, body, at = parse_turn(block, at)
            self.turns += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode())
            if loss is not None and loss.start <= body.start and body.stop <= loss.stop:
                self.loss += len(text)
                self.loss_hash.update(text.encode())
        self.formatted += len(block)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.turns_hash.hexdigest(), self.loss,
                self.loss_hash.hexdigest(), self.formatted)


def read_back(blocks: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest what comes out.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Blocks
    are sorted by (conv_id, turn, block), nulls first, so that rows with equal turn numbers
    have one order and repeated rows stay repeated turns. A task streams through its
    conversations with one block and two running digests in memory.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = (f"conv_id {column_type(blocks, 'conv_id')}, n_turns long, turns_sha256 string, "
              "loss_chars long, loss_sha256 string, formatted_chars long")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, id_type = None, [], None
        for batch in batches:
            id_type = batch.column(0).type
            for conv_id, block, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(block, None if start is None else slice(start, end))
            if done:
                yield _rows(done, id_type)
                done = []
        if now is not None:
            yield _rows([now.row()], id_type)

    def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "block")
    return ordered.select("conv_id", "block", "loss_start", "loss_end").mapInArrow(digest, schema)
