"""Toxicity by subword-bag embeddings and a linear softmax (operator 6).

A word is the mean of its character n-gram vectors, a window of words the mean of its words,
and a linear softmax over the window decides. Vectors and softmax are trained together in
numpy, so a misspelling that was never seen shares most of its vectors with the word it hides. A
document is as toxic as its worst window, calibrated on whole documents.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import column_type, parted, pieces, texts
from pulsegrid.session import stored

N_GRAMS = (3, 4, 5)
BLANK = 32


@dataclass(frozen=True)
class Params:
    """Bounds of the training sample, and of the model; none depends on the input's size."""

    docs_per_class: int = 2_500  # labelled documents, in hash order
    windows_per_doc: int = 256  # training windows of one document, drawn by its id
    window: int = 2  # words
    bits: int = 17  # of an n-gram's bucket
    dim: int = 8
    steps: int = 120
    warm_steps: int = 40  # with each document's label on all of its windows
    relabel_every: int = 10
    toxic_windows: int = 6  # of one toxic document that count, once the model finds them toxic
    rate: float = 0.05
    decay: float = 1e-6
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """`grams` is each bucket's vector times the softmax's difference of classes."""

    grams: np.ndarray
    bias: float
    slope: float
    length_slope: float
    offset: float
    window: int
    constant: float | None = None

    def probability(self, worst: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(worst), self.constant)
        z = self.slope * worst + self.length_slope * np.log1p(n_words) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def subwords(values: list[str], bits: int) -> tuple[np.ndarray, ...]:
    """Buckets of all n-grams of some texts, grouped by word.

    Returns buckets, the first n-gram of each word and one end more, and the first word of each
    text and one end more. Words are lower case, split at white space, with a blank at
    either side, which n-grams may begin or end with.
    """
    lower = [v.lower() for v in values]
    joined = " " + "".join(v + " " for v in lower)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    blank = (chars == BLANK) | ((chars >= 9) & (chars <= 13))
    chars[blank] = BLANK
    size = len(chars)
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    inner = np.cumsum(blank, dtype=np.int64)
    hashes, valid = [], []
    for n in N_GRAMS:
        last = size - n + 1
        h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        ok = np.zeros(size, bool)
        if last > 0:
            for k in range(n):
                h[:last] = (h[:last] ^ chars[k:k + last]) * np.uint32(0x01000193)
            ok[:last] = inner[n - 2:n - 2 + last] == inner[:last]  # no blank strictly inside
        hashes.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits))
        valid.append(ok)
    grid_ok = np.stack(valid, axis=1)
    buckets = np.stack(hashes, axis=1)[grid_ok].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(grid_ok.sum(axis=1))])
    # N-grams of a word begin between the blank before it and its last character.
    edges = np.concatenate([before[starts - 1], [len(buckets)]])
    lengths = np.array([len(v) + 1 for v in lower], np.int64)
    doc_at = 1 + np.concatenate([[0], np.cumsum(lengths)])
    return buckets, edges, np.searchsorted(starts, doc_at)


def _word_values(model_grams: np.ndarray, buckets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(model_grams[buckets], dtype=np.float64)])
    count = np.diff(edges)
    return (total[edges[1:]] - total[edges[:-1]]) / np.maximum(count, 1)


def worst_windows(model: Model, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The highest window logit of each text (the bias without words) and its words."""
    worst, n_words = np.full(len(values), model.bias), np.zeros(len(values), np.int64)
    bits = int(len(model.grams)).bit_length() - 1
    for part in pieces(values, 500_000):
        buckets, edges, doc_words = subwords(values[part], bits)
        words = _word_values(model.grams, buckets, edges)
        first, end = doc_words[:-1], doc_words[1:]
        n_words[part] = end - first
        if not len(words):
            continue
        total = np.concatenate([[0.0], np.cumsum(words)])
        at = np.arange(len(words))
        stop = np.repeat(end, end - first)
        to = np.minimum(at + model.window, stop)
        logits = (total[to] - total[at]) / (to - at)
        whole = (to - at == model.window) | (at == np.repeat(first, end - first))
        logits[~whole] = -np.inf
        filled = np.flatnonzero(end > first)
        worst[part.start + filled] = np.maximum.reduceat(logits, first[filled]) + model.bias
    return worst, n_words


def train_windows(texts: list[str], doc_labels: np.ndarray, params: Params) -> tuple[np.ndarray, float]:
    """Train n-gram vectors and softmax together; each bucket's weight and the bias.

    Whole-sample Adam steps; the two classes' softmax rows mirror each other. Every window first
    has its document's label. Later only the worst windows of a toxic document count as toxic,
    found anew every few steps, and its others not at all; both classes weigh the same.
    """
    rng = np.random.default_rng(params.seed)
    vocabulary: dict[str, int] = {}
    rows = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in text.lower().split()], np.int64)
            for text in texts]
    word_ids = np.concatenate(rows)
    ends = np.cumsum([len(r) for r in rows])
    starts = [np.arange(end - len(r), end, params.window) for end, r in zip(ends, rows)]
    groups = np.repeat(np.arange(len(rows)), [len(w) for w in starts])
    word_at = np.concatenate([*starts, ends[-1:]])
    labels = doc_labels[groups]
    buckets, edges, _ = subwords(list(vocabulary), params.bits)
    grams_of_word, words_of_window = np.diff(edges), np.diff(word_at)

    vectors = rng.normal(0, 0.05, (1 << params.bits, params.dim))
    toward = rng.normal(0, 0.3, params.dim)  # toxic row of the softmax less the clean one
    bias = np.zeros(1)
    state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (vectors, toward, bias)]
    toxic = labels == 1

    def logits() -> np.ndarray:
        scores = vectors @ toward
        words = np.add.reduceat(scores[buckets], edges[:-1]) / grams_of_word
        return np.add.reduceat(words[word_ids], word_at[:-1]) / words_of_window + bias[0]

    weight = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    for turn in range(1, params.steps + 1):
        logit = logits()
        if turn > params.warm_steps and turn % params.relabel_every == 1:
            order = np.lexsort((-logit, groups))
            place = np.empty(len(order), np.int64)
            first = np.concatenate([[0], np.cumsum([len(w) for w in starts])])
            place[order] = np.arange(len(order)) - first[groups[order]]
            counted = toxic & ((place == 0) | ((logit > 0) & (place < params.toxic_windows)))
            weight = np.where(toxic, counted * 0.5 / counted.sum(), 0.5 / max((~toxic).sum(), 1))
        wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic) * weight
        by_word = np.bincount(word_ids, np.repeat(wrong / words_of_window, words_of_window), len(vocabulary))
        by_gram = np.bincount(buckets, np.repeat(by_word / grams_of_word, grams_of_word), len(vectors))
        slopes = (np.outer(by_gram, toward) + params.decay * vectors,
                  vectors.T @ by_gram + params.decay * toward, np.array([wrong.sum()]))
        for (x, mean, square), slope in zip(state, slopes):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            x -= params.rate * (mean / (1 - 0.9 ** turn)) / (np.sqrt(square / (1 - 0.99 ** turn)) + 1e-10)
    return vectors @ toward, float(bias[0])


def _calibrate(worst: np.ndarray, n_words: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on the worst window and the length, by Newton steps."""
    centre, spread = worst.mean(), worst.std() + 1e-9
    x = np.stack([(worst - centre) / spread, np.log1p(n_words), np.ones(len(worst))], 1)
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w -= np.linalg.solve(hessian, x.T @ (p - labels) + 1e-2 * w)
    return w[0] / spread, w[1], w[2] - w[0] * centre / spread


def held_out(id_col: str) -> F.Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    At most docs_per_class documents of either label are taken, in the order of a hash of
    the id, and at most windows_per_doc of their windows for training. A quarter of the documents is
    not trained on; they are read whole to calibrate the score. With repeated labels the highest counts; null ids and labels do not.
    Without rows of both labels the model is constant: the share of toxic rows, or 0.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")))
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(params.docs_per_class)
              for y in (1, 0)]
    ids = picked[0].unionByName(picked[1])  # at most 2 * docs_per_class rows
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = stored(own.join(F.broadcast(ids), "id"), "toxic-sample")
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    empty = np.zeros(2)
    if len(counts) < 2:
        return Model(empty, 0.0, 0.0, 0.0, 0.0, params.window, float(counts.get(1, 0) > 0))

    most, size = params.windows_per_doc, params.window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for ident, text, label in zip(batch.column(0).to_pylist(), texts(batch, "text"), batch.column(2).to_pylist()):
                words = text.split()
                at = range(0, len(words), size)
                if len(at) > most:
                    rng = np.random.default_rng(abs(ident) if isinstance(ident, int) else 0)
                    at = sorted(rng.choice(np.array(at), most, replace=False).tolist())
                out.append((ident, label, " ".join(w for a in at for w in words[a:a + size])))
            kinds = [batch.column(0).type, pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 3, kinds)], names=["id", "label", "words"])

    # Bounded: 2 * docs_per_class rows of windows_per_doc * window words each.
    aside = F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(4)) == 0
    rows = (sample.where(~aside).mapInArrow(cut, f"id {column_type(sample, 'id')}, label int, words string")
            .where("words <> ''").orderBy("id", "words").toPandas())
    if rows["label"].nunique() < 2:
        return Model(empty, 0.0, 0.0, 0.0, 0.0, size, counts[1] / sum(counts.values()))
    grams, bias = train_windows(rows["words"].tolist(), rows["label"].to_numpy().astype(np.int64), params)
    raw = Model(grams.astype(np.float32), bias, 1.0, 0.0, 0.0, size)
    fit = worst_table(sample.withColumn("aside", aside), raw, keep=["label", "aside"]).orderBy("id", "worst").toPandas()
    if fit.loc[fit["aside"], "label"].nunique() == 2:
        fit = fit[fit["aside"]]
    slope, length_slope, offset = _calibrate(
        fit["worst"].to_numpy(), fit["n_words"].to_numpy(), fit["label"].to_numpy().astype(float))
    return Model(raw.grams, bias, slope, length_slope, offset, size)


def worst_table(rows: DataFrame, model: Model, keep: list[str] = []) -> DataFrame:
    """id, the columns to keep, worst window and words of each row's text."""
    first = rows.select("id", *keep, "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst, n_words = worst_windows(model, texts(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(worst, pa.float64()), pa.array(n_words, pa.int64())],
                names=[*batch.schema.names[:-1], "worst", "n_words"])

    kinds = ", ".join(f"{c} {column_type(first, c)}" for c in ("id", *keep))
    return first.mapInArrow(read, f"{kinds}, worst double, n_words long")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: id_col, held_out, score, predicted; other columns are not kept.

    Null and empty texts get the score of a window without words. A null id stays null and is not
    held out; repeated rows get equal scores. No row leaves its task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, "text"):
            p = model.probability(*worst_windows(model, texts(batch, "text")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    scored = rows.mapInArrow(read, f"id {column_type(docs, id_col)}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is not toxic, with all their columns as they were."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, text_col):
            p = model.probability(*worst_windows(model, texts(batch, text_col)))
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(keep, docs.schema)
