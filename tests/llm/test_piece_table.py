"""Fill-in-middle against plain string cutting, with its edge cases."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import piece_table as pt

MARKS = ("<P>", "<S>", "<M>")


def plain(text, ident, rate=100, spm=50):
    """The rules spelled out over lists of lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a\n<PSM>é\r", max_size=30), st.integers(-9, 10**12), st.sampled_from([0, 40, 100]))
def test_texts(text, ident, rate):
    n, form, before, middle, table = pt.transform_text(text, ident, 7, rate, 50, MARKS)
    assert (n, form, before, middle, table.text()) == plain(text, ident, rate)
    assert table.sha256() == hashlib.sha256(table.text().encode()).hexdigest()
    back = pt.PieceTable(table.text(), MARKS)
    if form != "plain":
        back.restore(form)
    assert back.text() == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.lists(st.integers(0, 12), max_size=6))
def test_cutting_keeps_characters(text, places):
    table = pt.PieceTable(text, MARKS)
    places = sorted(min(p, len(text)) for p in places)
    table.cut(*places)
    assert list(table.spans()) == [s for s in (text[a:b] for a, b in zip([0, *places], [*places, len(text)])) if s]
    table.cut(*places)  # cutting again where it is cut changes no character
    assert table.text() == text


def test_sentinels_must_not_overlap():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("abc", "b", "d"), ("", "b", "c")):
        with pytest.raises(ValueError):
            pt.check_marks(marks)
    pt.check_marks(MARKS)
    with pytest.raises(ValueError):
        pt.PieceTable("x<P>a<S>b<M>c", MARKS).restore("psm")


def test_documents(spark):
    long = "é line\n" * 400_000 + "x" * 2_000_000
    texts = ["", None, "one", "a\nb\nc", "\n\n", "has <M> inside\nb", "a<\nP>b\n<", long, "a\x00b\n\x0bé", "same", "same"]
    rows = [(i, t, "f", i) for i, t in enumerate(texts)] + [(3, "a\nb\nc", "f", 0), (None, "p\nq\nr\n", "f", 0), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long").withColumn("output", F.lit("x"))
    made = pt.fill_in_middle(docs)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())
    assert got == Counter((i, *plain(t, i)) for i, t, _, _ in rows)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    back = pt.restore_middle(made.withColumn("text", F.lit("not this")).withColumn("k0", F.lit(1)))
    assert Counter((r.doc_id, r.text, r.k0) for r in back.collect()) == Counter((i, t or "", 1) for i, t, _, _ in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter(r.restored_sha256 for r in back.collect()) == Counter(sha(t or "") for _, t, _, _ in rows)
    assert pt.fill_in_middle(docs.where("false")).count() == 0
    assert pt.restore_middle(made.where("false")).count() == 0
