"""The filter audit against a plain walk through every order, document by document."""

import random
import re
from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from pulsegrid.llm import filter_audit

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(rows):
    """The letters that each document fails."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = sum("A" <= c <= "Z" for c in text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * capitals > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        out.append({f for f, v in fails.items() if v})
    return out


def brute(rows, labels):
    fails = failures(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    shapley = defaultdict(int)
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, fails) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                failing = sum(letter in f for _, f in own)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(f == {letter} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, letter] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def made(rng):
    words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 30, 199, 200, 260]))]
    if rng.random() < 0.3:
        words = words[:8] * 30
    if rng.random() < 0.3:
        words = [w.upper() for w in words]
    return " \n\x0b".join(words) + rng.choice(["", "", " #", " é|"])


def test_orders(spark):
    rng = random.Random(13)
    texts = [made(rng) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(160)]
    rows += [(3, rows[3][1], "a"), (3, rows[3][1], "a"), (0, rows[5][1], "b"), (None, rows[3][1], "a"), (None, "", None),
             (None, None, None), (900, None, "c"), (901, "", "c"), (902, "A" * 3 + "x" * 147, "c"), (903, "é" * 50, "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumn("n", F.lit(1)).withColumn("mask", F.lit("x")).withColumn("quality", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = filter_audit.audit_filters(docs.repartition(5), marks).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * 5
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in [*COUNTS, "shapley"]) for r in got} == want
    assert all(r.filter == r.filter_order[r.step - 1] for r in got)
    assert filter_audit.audit_filters(docs.where("false"), marks).count() == 0
    bare = filter_audit.audit_filters(docs.where("doc_id = 903"), marks.where("false")).collect()
    assert len(bare) == 600 and not any(r.good_lost or r.toxic_lost for r in bare)


def test_long_text(spark):
    text = " ".join(["word"] * 2_000_000) + "Z" * 3_000_000
    docs = spark.createDataFrame([(1, text, "a"), (2, text, "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in filter_audit.audit_filters(docs, labels).collect()}
    assert got["EABCD", 1].removed == got["EABCD", 1].good_lost == 1 and got["EABCD", 3].removed == 1
    assert got["ABCDE", 3].redundant == 2 and got["ABCDE", 1].kept == 2
