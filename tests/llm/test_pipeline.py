"""Each stage of the pipeline over a whole small table, against a plain version of it."""

from collections import Counter

import corpus_pipeline
from pulsegrid.llm import catalog, mixing, packing, secret_scan, toxicity
from pulsegrid.session import stored

from .test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = catalog.table(spark, SF, "documents")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), "stage"))
    assert all(t.columns == docs.columns for t in tables[1:-1])
    read, clean, single, masked, mixed = (t.collect() for t in tables[:-1])

    model = toxicity.learn(docs, catalog.table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert Counter(clean) == Counter(r for r in read if r.doc_id not in toxic)

    classes = brute([(r.doc_id, r.text) for r in clean])
    assert Counter(single) == Counter(r for r in clean if classes[r.doc_id][1] == r.doc_id)

    want = {r.doc_id: secret_scan.redact(r.text, 36.0, "[SECRET]") for r in single}
    assert {r.doc_id: r.text for r in masked} == want
    assert len(masked) == len(single) and all(r.n_chars == len(r.text) for r in masked if "[SECRET]" in r.text)

    copies = {r.doc_id: r.copies for r in mixing.mix(tables[3]).collect()}
    times = Counter(r.doc_id for r in mixed)
    assert set(mixed) <= set(masked) and all(abs(times[d] - c) <= 0.5 for d, c in copies.items())

    encode = packing.byte_encoder(**{k: v for k, v in catalog.byte_pieces().items() if k != "special"}, special=()).encode_ordinary
    got = Counter()
    for r in tables[-1].select("doc_id", "length").collect():
        got[r.doc_id] += r.length
    assert got == Counter({d: n * (len(encode(want[d])) + 1) for d, n in times.items()})
