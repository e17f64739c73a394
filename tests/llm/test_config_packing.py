"""Best-fit packing: the knapsack and plans against exhaustive search, ids against the library, with edge cases."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import config_packing as cp

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LETTERS = list("aBcE12's LL .,!\n\x1c\x85\xa0éÉßİſ×̈́Σσς日　\x00<|>ǰŸ½Ⅷª_") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "H̱"]


def whole_ids(text):
    return cp.word_ids(VOCABULARY).tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.tuples(st.integers(1, 4), st.integers(0, 9)), min_size=1, max_size=5),
       st.integers(0, 25))
def test_knapsack_is_best(items, room):
    lengths = np.array(list(items))
    limits, values = (np.array(v, float) for v in zip(*items.values()))
    got = cp.best_fill(lengths, limits.astype(int), values, room)

    @lru_cache(None)
    def best(k, left):
        if k == len(lengths):
            return 0.0
        return max(n * values[k] + best(k + 1, left - n * int(lengths[k]))
                   for n in range(int(limits[k]) + 1) if n * lengths[k] <= left)

    assert (got <= limits).all() and got @ lengths <= room
    assert got @ values == best(0, room)


def least_sequences(pieces, capacity):
    """Exhaustive: each piece, longest first, in each open sequence or a new one."""
    best = len(pieces)

    def place(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(pieces):
            best = len(gaps)
            return
        for gap in {g for g in gaps if g >= pieces[k]}:
            rest = list(gaps)
            rest[rest.index(gap)] -= pieces[k]
            place(k + 1, rest)
        place(k + 1, [*gaps, capacity - pieces[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_small_plans(pieces):
    plan = cp.plan_sequences(Counter(pieces), 20)
    used = Counter()
    for copies, lengths, counts in plan:
        assert np.dot(lengths, counts) <= 20 and list(lengths) == sorted(lengths, reverse=True)
        used.update({n: copies * c for n, c in zip(lengths, counts)})
    assert used == Counter(pieces)
    assert sum(p.copies for p in plan) <= least_sequences(sorted(pieces, reverse=True), 20) + 1


@pytest.mark.parametrize("spread, times", [((1, 4096), 1), ((1, 4096), 300), ((30, 900), 7), ((1, 4096), 10**9)])
def test_large_plans(spread, times):
    """Plans come near a bound from below and do not grow with the counts. Lengths spread evenly up to the
    capacity are the hardest: nearly every sequence needs one long piece and its complement."""
    draw = np.random.default_rng(4)
    histogram = {int(n): int(c) * times for n, c in zip(range(*spread, 3), draw.geometric(0.2, 9999))}
    plan = cp.plan_sequences(histogram, 4096)
    # all tokens over the capacity; and no two pieces over half of it share a sequence
    bound = max(sum(n * c for n, c in histogram.items()) / 4096, sum(c for n, c in histogram.items() if n > 2048))
    assert bound <= sum(p.copies for p in plan) <= (1.02 if spread[1] > 2048 else 1.002) * bound + 1
    assert len(plan) < 6 * len(histogram)


def test_cover_is_fractional_and_kept():
    lengths, counts = np.array([3000, 1500, 900, 100]), np.array([10**6, 10**6, 10**6, 10**7])
    covered = np.zeros(4)
    for places, config, amount in cp.fractional_cover(lengths, counts, 4096):
        assert lengths[places] @ config <= 4096
        covered[places] += amount * config
    assert (covered <= counts + 1e-6).all() and (covered > 0.9 * counts).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=20).map("".join))
def test_ids(text):
    assert np.frombuffer(cp.word_ids(VOCABULARY)(text), "<u4").tolist() == whole_ids(text)


def test_memory_forgets(monkeypatch):
    monkeypatch.setattr(cp, "REMEMBERED", 3)
    ids = cp.WordIds(VOCABULARY)
    for odd in ("", "日"):
        text = " ".join(f"word{i % 7}x é{i % 5}{odd}" for i in range(90)) + " " + "long" * 50
        assert np.frombuffer(ids(text), "<u4").tolist() == whole_ids(text)
    assert max(len(ids.words), len(ids.words.older), len(ids.pieces)) <= 3


def check_pack(texts_of, got, capacity=4096):
    """Each document's ids in whole, each sequence gapless and within the capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= capacity
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert set(by_doc) == set(texts_of)
    for doc, texts in texts_of.items():
        wanted = Counter()
        for text in texts:
            ids = whole_ids(text or "") + [1]
            wanted.update((k // capacity, k, tuple(ids[k:k + capacity])) for k in range(0, len(ids), capacity))
        assert Counter((r.piece, r.start, tuple(r.ids)) for r in by_doc[doc]) == wanted
    return len(by_sequence)


def test_documents(spark):
    texts = ["", None, "one", "It's <|endoftext|> here", "word " * 4095, "word " * 4096, "word " * 9000, "é日 " * 300]
    texts += [f"{'some words ' * (k * 7 % 190)}{k}" for k in range(400)]
    rows = [(i, t, "p", i) for i, t in enumerate(texts)] + [(2, "one", "p", 1), (None, "no id", "p", 1), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, rank long").withColumn("ids", F.lit(1))
    texts_of = defaultdict(list)
    for i, t, _, _ in rows:
        texts_of[i].append(t)
    packed = cp.pack_best_fit(docs.repartition(7), VOCABULARY)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
    got = packed.collect()
    sequences = check_pack(texts_of, got)
    assert sequences <= -(-sum(r.length for r in got) // 4096) + 1
    small = cp.pack_best_fit(docs, VOCABULARY, capacity=64).collect()
    check_pack(texts_of, small, 64)
    assert cp.pack_best_fit(docs.where("false"), VOCABULARY).count() == 0


def test_many_equal_documents_share_few_patterns(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('a ', 99) AS text")
    got = cp.pack_best_fit(docs.repartition(9), VOCABULARY, keep_ids=False)
    assert got.select("sequence_id").distinct().count() == -(-30_000 // 40)
    assert got.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0


def test_long_text(spark):
    text = "word " * 1_000_000 + "x" * 200_000 + " tail" * 1_000_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = cp.pack_best_fit(docs, VOCABULARY, keep_ids=False).toPandas()
    tokens = len(cp.word_ids(VOCABULARY)(text)) // 4 + 1
    assert tokens > 2_000_000 and got["length"].sum() == tokens and got["sequence_id"].nunique() == -(-tokens // 4096)
