"""Quality rules as a learned decision list (operator 7).

Sequential covering grows conjunctions of thresholds on text statistics from labelled rows,
prunes each on rows kept aside, and emits the list as one ordered Spark conditional.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.arrow import column_type, texts

# What separates words, and the characters counted as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words")


def repeat_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    _, pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:n] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + n] |= twice
    return int(covered.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def text_stats(text: str) -> tuple[int, ...]:
    """The statistics named in STATS; words are split at ASCII white space only."""
    words = text.encode("utf-8", "surrogatepass").split()
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            dup_lines(text), repeat_words(words), text.count("\n") + 1,
            sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), sum(map(text.count, "0123456789")),
            text.count("!") + text.count("?"), len(set(words)))


def stats_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the statistics of every whole text, null as the empty text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(text_stats, texts(batch, "text")))) or [[]] * len(STATS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in found)], names=["id", *STATS])

    schema = f"id {column_type(docs, id_col)}, " + ", ".join(f"{s} long" for s in STATS)
    return rows.mapInArrow(read, schema).withColumnRenamed("id", id_col)


# What rules may speak of: (name, part, whole); a whole of None leaves the number itself.
FEATURES = (
    ("words", "n_words", None), ("word_length", "word_chars", "n_words"),
    ("symbol_share", "n_symbols", "word_chars"), ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"), ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"), ("mark_share", "n_marks", "word_chars"),
    ("distinct_share", "n_distinct_words", "n_words"), ("line_words", "n_words", "n_lines"),
)


@dataclass(frozen=True)
class Test:
    """One threshold: feature >= value, or feature < value."""

    feature: int
    at_least: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, self.feature]
        return column >= self.value if self.at_least else column < self.value

    def condition(self) -> Column:
        _, part, whole = FEATURES[self.feature]
        value = F.col(part).cast("double")
        if whole:
            value = F.when(F.col(whole) > 0, value / F.col(whole)).otherwise(0.0)
        return value >= self.value if self.at_least else value < self.value

    def __str__(self) -> str:
        return f"{FEATURES[self.feature][0]} {'>=' if self.at_least else '<'} {self.value:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(and_, (t.holds(x) for t in rule), np.ones(len(x), bool))


def _best_test(x: np.ndarray, bad: np.ndarray, cuts: int) -> Test | None:
    """The threshold with the highest information gain over the rows still covered."""
    now = np.log2(bad.sum() / len(bad))
    best, found = 1e-9, None
    for feature in range(x.shape[1]):
        column = x[:, feature]
        for value in np.unique(np.quantile(column, np.linspace(0, 1, cuts + 2)[1:-1], method="higher")):
            above = column >= value
            for at_least, mask in ((True, above), (False, ~above)):
                hit = int(bad[mask].sum())
                if hit:
                    gain = hit * (np.log2(hit / mask.sum()) - now)
                    if gain > best:
                        best, found = gain, Test(feature, at_least, float(value))
    return found


def learn_list(x: np.ndarray, bad: np.ndarray, precision: float = 0.95, least: int = 5,
               cuts: int = 48, most_tests: int = 4, seed: int = 3) -> list[Rule]:
    """Sequential covering: rules that reject, in order.

    Each rule grows on two thirds of the rows still uncovered, test by test, until it covers no
    good row; then its last tests are dropped as long as that does not lower
    (bad - good) / (bad + good) on the other third. Learning ends with the first rule
    that covers fewer than `least` bad rows or is less precise than `precision` on all rows left.
    """
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while bad[left].sum() >= least:
        own = np.flatnonzero(left)
        grow = rng.random(len(own)) < 2 / 3
        grown, kept = own[grow], own[~grow]
        rule: Rule = ()
        while len(rule) < most_tests:
            inside = grown[covers(rule, x[grown])]
            if not len(inside) or not bad[inside].any() or bad[inside].all():
                break
            test = _best_test(x[inside], bad[inside], cuts)
            if test is None:
                break
            rule = (*rule, test)

        def worth(part: Rule) -> float:
            inside = bad[kept[covers(part, x[kept])]]
            return (2 * inside.sum() - len(inside)) / max(len(inside), 1) if len(inside) else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        inside = own[covers(rule, x[own])] if rule else own[:0]
        if bad[inside].sum() < least or bad[inside].mean() < precision:
            break
        rules.append(rule)
        left[inside] = False
    return rules


def matrix(rows) -> np.ndarray:
    """Feature values of a pandas frame of statistics, as the Spark conditions see them."""
    columns = []
    for _, part, whole in FEATURES:
        value = rows[part].to_numpy(np.float64)
        if whole:
            base = rows[whole].to_numpy(np.float64)
            value = np.divide(value, base, out=np.zeros(len(value)), where=base > 0)
        columns.append(value)
    return np.stack(columns, 1)


def learn_rules(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality", **how) -> list[Rule]:
    """A decision list from at most `most_rows` labelled rows, in the order of a hash of the id.

    With repeated labels the lowest counts; null ids and labels do not. Without rows of both
    labels the list is empty.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(most_rows))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = own.join(F.broadcast(known.select("id")), "id", "left_semi")  # most_rows ids at most
    rows = (stats_table(sample, "id").join(F.broadcast(known), "id")
            .select("id", "label", *STATS).distinct().orderBy("id", *STATS).toPandas())
    bad = rows["label"].to_numpy() == 0
    if not len(rows) or bad.all() or not bad.any():
        return []
    return learn_list(matrix(rows), bad, **how)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the first rule that holds rejects."""
    if not rules:
        return F.lit(True)
    first, *rest = [reduce(and_, (t.condition() for t in rule)) for rule in rules]
    return reduce(lambda chain, c: chain.when(c, False), rest, F.when(first, False)).otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], least_words: int = 50, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Statistics, base_failed and kept for every whole text; other columns are not kept.

    base_failed: fewer than `least_words` words, or over half of them in repeated windows. Null
    and empty texts have no words and so fail. A null id stays null, repeated rows stay repeated.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (stats_table(docs, id_col, text_col)
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))
