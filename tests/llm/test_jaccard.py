"""The similarity join against all pairs, and its cases at the edge."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from pulsegrid.llm import jaccard_join
from pulsegrid.llm.shingles import shingle_sets

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("sig", T.StringType())])  # a column that clashes with an inner name


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))}


def brute(rows) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def family_texts(seed: int) -> list[str]:
    """Families of copies with few to many edits, and a passage that unrelated texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(30)]
    out = []
    for size in (1, 3, 5, 8, 40, 90, 200):
        base = [word() for _ in range(size)]
        for copy in range(14):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, size // 15))):
                at = rng.randrange(len(text))
                rng.choice((lambda: text.__setitem__(at, word()), lambda: text.insert(at, word()),
                            lambda: len(text) > 1 and text.pop(at)))()
            out.append(" ".join(text) if copy % 3 else "\t".join(text).upper())
    out += [" ".join([word() for _ in range(rng.randrange(5, 60))] + passage) for _ in range(25)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("frequent", [2, 64])
def test_components_equal_all_pairs(spark, frequent):
    rows = list(enumerate(family_texts(frequent)))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.link_documents(docs, frequent=frequent).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 20


@pytest.mark.parametrize("per_block", [3, 1_000])
def test_links_are_counted_whole(spark, per_block):
    rows = list(enumerate(family_texts(1)))
    rows += [(d + 1_000, t) for d, t in rows[::9]] + [(2_000, None), (2_001, "")]
    sets = {d: shingles(t) for d, t in rows}
    want = {d: sum(o != d and bool(s) and 100 * len(s & other) >= 80 * len(s | other) for o, other in sets.items())
            for d, s in sets.items()}
    null = (None, rows[0][1], "x")
    docs = spark.createDataFrame([*((d, t, "x") for d, t in [*rows, rows[0], rows[5]]), null, null], DOCS)
    for d, s in sets.items():  # two documents without ids
        want[d] += 2 * (100 * len(s & sets[0]) >= 80 * len(s | sets[0]))
    got = {r.doc_id: r.n_links for r in jaccard_join.link_documents(docs, per_block=per_block).collect()}
    assert got == want | {None: want[0]}
    assert max(want.values()) > 9


def test_nulls_repeats_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(300)) * 3
    rows = [(4, None), (3, ""), (2, " \n "), (9, "a b"), (7, "A\tb"), (5, long), (6, long), (6, long), (None, long)]
    docs = spark.createDataFrame([(d, t, None) for d, t in rows], DOCS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id)
                 for r in jaccard_join.link_documents(docs).collect())
    n = len(shingles(long))
    assert got == [(False, 2, 0, 2), (False, 3, 0, 3), (False, 4, 0, 4), (False, 5, n, 5), (False, 6, n, 5),
                   (False, 6, n, 5), (False, 7, 1, 7), (False, 9, 1, 7), (True, 0, n, 5)]
    kept = jaccard_join.keep_one(docs, jaccard_join.link_documents(docs, name_rows=True)).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 2, 3, 4, 5, 7]
    assert kept[0].asDict().keys() == {"doc_id", "text", "sig"}
    assert jaccard_join.link_documents(docs.where("false")).count() == 0


def test_keep_one_goes_by_rows(spark):
    """An id that repeats with other texts loses none of them; each group keeps one row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a59", "other")
    for rows, want in (([(3, a), (5, a), (5, b)], {(3, a), (5, b)}), ([(5, b), (5, a), (3, near)], {(3, near), (5, b)}),
                       ([(5, b), (5, c), (5, b), (7, c)], {(5, b), (5, c)}), ([(1, ""), (1, None), (2, "")], None)):
        docs = spark.createDataFrame([(d, t, None) for d, t in rows], DOCS)
        for count_links in (False, True):
            kept = jaccard_join.keep_one(docs, jaccard_join.link_documents(docs, name_rows=True, count_links=count_links)).collect()
            if want is None:
                assert sorted(r.doc_id for r in kept) == [1, 2]
            else:
                assert {(r.doc_id, r.text) for r in kept} == want and len(kept) == len(want)


def test_shingles_do_not_depend_on_their_place():
    texts = ["one two three four five six", "x one two three four five six", "É one two three four five"]
    alone = [shingle_sets([t])[0] for t in texts]
    for together, own in zip(shingle_sets(texts), alone):
        assert np.array_equal(together, own)
    assert len(np.intersect1d(*alone[:2])) == 2


def test_walk_stops_and_goes_on():
    probe = np.arange(100, dtype=np.uint64)
    walk = jaccard_join.PathWalk(probe, 80)
    paths = sorted((np.array(sorted(random.Random(i).sample(range(110), 95)), np.uint64) for i in range(60)),
                   key=lambda p: p.tolist())
    for path in [*paths, probe]:
        shared = len(np.intersect1d(path, probe))
        assert walk.similar(path) == (100 * shared >= 80 * (len(path) + 100 - shared))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in jaccard_join.components(links).collect()}
    assert {v for k, v in got.items() if k < 100} == {0} and got[101] == 100


def test_parity_sketches_never_overstate_a_difference():
    rng = np.random.default_rng(5)
    for n, edits in ((0, 1), (1, 1), (180, 0), (180, 20), (180, 60), (5000, 900)):
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(np.concatenate([own[edits:], rng.integers(0, 1 << 63, edits, dtype=np.uint64)]))
        bits = jaccard_join._parity(own) ^ jaccard_join._parity(other)
        least = sum(int(b).bit_count() for b in bits.view(np.uint64))
        differ = len(np.setxor1d(own, other))
        assert least <= differ and (least >= 0.8 * differ or differ > 100)
