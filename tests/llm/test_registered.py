"""The corpus queries that SQL can tell, against it, on the smallest scale."""

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from pulsegrid.llm import catalog

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(catalog.QUERIES) | {"pipeline"} <= set(queries())
    assert {int(name[2:].split("_")[0]) for name in catalog.QUERIES} == set(range(1, 14))
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and catalog.ORACLES.items() <= oracle_sql().items()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "secrets", "mixing", "packing"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda names, data: sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in data)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
