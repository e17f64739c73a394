import os
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpers import at, rows
from pulsegrid import schemas, session
from pulsegrid.sources import messages, readers, writers


def canonical(spark, n=103):
    data = [(i % 3, at(i * 7 % n / 4), "hr", float(i), "chart", i) for i in range(n)]
    return spark.createDataFrame(data, "icustay_id bigint, charttime timestamp, signal_name string, valuenum double, source_table string, id bigint")


def test_csv_tables(spark, tmp_path):
    path = tmp_path / "stays.csv"
    path.write_text("icustay_id,subject_id,hadm_id,intime,outtime,los,dbsource\n"
                    "1,2,3,2024-01-01 01:00:00,2024-01-02,1.5,x\n2,2,bad,nope,,,\n")
    got = readers.read_csv_table(spark, str(path), schemas.STAYS)
    assert rows(got, "icustay_id", "hadm_id", "intime", "outtime") == [(1, 3, at(1), at(24)), (2, None, None, None)]
    with pytest.raises(AnalysisException):
        readers.read_csv_table(spark, str(tmp_path / "missing.csv"), schemas.STAYS)
    empty = tmp_path / "empty.csv"
    empty.write_text("icustay_id,subject_id,hadm_id,intime,outtime,los,dbsource\n")
    assert readers.is_empty(readers.read_csv_table(spark, str(empty), schemas.STAYS))


def test_split_and_manifest(spark, tmp_path):
    df = canonical(spark)
    chunks = writers.split_ordered(df, ["charttime", "id"], 10).checkpoint()
    man = sorted(writers.split_manifest(chunks, "charttime").collect())
    assert [r["row_count"] for r in man] == [10] * 9 + [13]
    assert all(a["max_time"] <= b["min_time"] for a, b in zip(man, man[1:]))
    total = writers.manifest_totals(chunks, "charttime", "signal_name").first()
    assert (total["total_rows"], total["n_files"], total["signals"]) == (103, 10, ["hr"])
    path = str(tmp_path / "split")
    writers.write_split(chunks.drop("id"), path, ["charttime"])
    assert rows(readers.read_events(spark, path)) == rows(df.drop("id"))
    few = writers.split_ordered(df.limit(3), ["charttime", "id"], 10)
    assert sorted(r["chunk"] for r in few.collect()) == [0, 1, 2]


def test_csv_append_and_metrics(spark, tmp_path):
    df, path = canonical(spark, 5).drop("id"), str(tmp_path / "log")
    writers.append_csv(df, path)
    writers.append_csv(df, path)
    assert readers.read_events(spark, path).count() == 10
    doc = str(tmp_path / "doc")
    writers.write_metrics(spark.createDataFrame([(1.5, "x")], "p50 double, name string"), doc)
    assert tuple(readers.read_metrics(spark, doc).select("p50", "name").first()) == (1.5, "x")


def test_parquet_scans_prune_columns(spark, tmp_path):
    path = str(tmp_path / "w")
    writers.write_table(canonical(spark), path)
    (tmp_path / "w" / "_checkpoint").mkdir()
    got = readers.read_windows(spark, path, ["icustay_id", "charttime"])
    assert got.count() == 103
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<icustay_id:bigint,charttime:timestamp>" in plan


def test_messages_round_trip(spark):
    df = canonical(spark, 9)
    made = messages.encode_events(df, F.lit(1000))
    assert made.columns == ["value"]
    back = messages.with_latency(messages.decode_events(made), F.lit(1250))
    assert rows(back.select(df.drop("id").columns)) == rows(df.drop("id"))
    assert {r["latency_ms"] for r in back.collect()} == {250}
    broken = messages.decode_events(spark.createDataFrame([("{oops",)], "value string")).first()
    assert broken["icustay_id"] is None and broken["charttime"] is None
    live = messages.with_latency(messages.decode_events(messages.encode_events(df))).collect()
    assert all(0 <= r["latency_ms"] < 60_000 for r in live)


def test_broadcast_only_what_was_counted(spark):
    small, plan = spark.range(10), lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "hint" in plan(session.broadcast_if_small(small, 10).join(small, "id")) or "strategy=broadcast" in plan(
        session.broadcast_if_small(small, 10).join(small, "id"))
    assert "broadcast" not in plan(session.broadcast_if_small(small, 9).join(small, "id"))


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x").startswith(named)
    kept = session.stored(spark.range(3))
    root = os.path.join(named, f"pulsegrid-{spark.sparkContext.applicationId}")
    assert kept.count() == 3 and os.listdir(root)
    spark.range(3).checkpoint()
    assert spark.sparkContext.getCheckpointDir().removeprefix("file:").startswith(named)


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError):
        session.shared_dir(bare)
