import random
import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F, types as T

from helpers import at, rows
from pulsegrid.functions import fixed_values as fv
from pulsegrid.operators import learn
from pulsegrid.operators import windows as win
from pulsegrid.plans import catalog
from pulsegrid.sources import writers
from pulsegrid.streaming import ledger, progress, scoring, state, stream

SIG = ["a", "b"]
COLS = ["icustay_id", "window_start_time", "window_end_time", *[f"{s}_{t}" for s in SIG for t in fv.STATS], "n_events"]


def make_events(spark, n=200, seed=1, start=0.0):
    rnd = random.Random(seed)
    data = [(rnd.choice([1, 1, 2]), at(start + i / 20), rnd.choice(SIG), float(rnd.randint(1, 99)), "t") for i in range(n)]
    return spark.createDataFrame(data, "icustay_id bigint, charttime timestamp, signal_name string, valuenum double, source_table string")


def add_file(df, path):
    """One more CSV file, later than those before it."""
    time.sleep(1.1)
    df.coalesce(1).write.mode("append").option("header", True).option("timestampFormat", fv.TIME_FORMAT).csv(path)


def features(df):
    return win.sliding_features(df, "icustay_id", "charttime", "signal_name", "valuenum", SIG)


def source(spark, path, max_files=None):
    return stream.with_watermark(stream.stream_files(spark, path, max_files=max_files))


def tidy(df):
    return rows(df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]))


def drain(spark, df, path, ckpt):
    stream.run_available(stream.sink_parquet(df, path, ckpt))
    return spark.read.parquet(path)


def closed(batch, events):
    last = events.agg(F.max("charttime")).first()[0]
    return batch.where(F.col("window_end_time") <= F.lit(last) - F.expr("interval 1 hour"))


def test_stream_is_batch_without_the_open_windows(spark, tmp_path):
    ev, path = make_events(spark), str(tmp_path / "in")
    add_file(ev, path)
    got = drain(spark, features(source(spark, path)), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = closed(features(ev), ev)
    assert tidy(got.select(COLS)) == tidy(want.select(COLS)) and want.count() > 20


def test_files_in_time_order_lose_nothing_and_late_rows_are_counted(spark, tmp_path):
    path = str(tmp_path / "in")
    parts = [make_events(spark, 60, i, start=i * 3.0) for i in range(3)]
    for p in parts:
        add_file(p, path)
    add_file(make_events(spark, 10, 9, start=0.0), path)  # far too late
    with progress.ProgressTable(spark, str(tmp_path / "log"), most=2) as log:
        got = drain(spark, features(source(spark, path, 1)), str(tmp_path / "out"), str(tmp_path / "ck"))
        log.settle(1)
    ev = parts[0].unionAll(parts[1]).unionAll(parts[2])
    assert tidy(got.select(COLS)) == tidy(closed(features(ev), ev).select(COLS))
    told = progress.read_progress(spark, log.path)
    assert {r["event"] for r in told.collect()} == {"started", "progress", "terminated"} and not log._waiting
    late = {r["batch"]: r for r in progress.late_rows(told).collect()}
    assert [late[i]["n_rows"] for i in range(4)] == [60, 60, 60, 10] and [late[i]["n_late"] > 0 for i in range(4)] == [False] * 3 + [True]


def test_chunks_replay_in_order(spark, tmp_path):
    """Six chunks give six micro-batches or more in the order of time, and no row is late, though the
    files were written at once; fill and positions over them equal the batch."""
    ev, path = make_events(spark, 600, 4), str(tmp_path / "in")
    chunked = writers.split_ordered(ev.withColumn("n", F.monotonically_increasing_id()).checkpoint(), ["charttime", "n"], 6)
    seen = []
    assert ledger.commit_chunks(chunked, path, ["charttime", "n"], after=lambda: seen.append(1)) >= 6 and len(seen) == 6
    raw = stream.stream_files(spark, path, ev.schema, "parquet", "*.parquet", max_files=1)
    keep = ["icustay_id", "window_start_time", "window_end_time", *[f"{s}_last" for s in SIG]]
    feats = features(stream.with_watermark(raw))
    with progress.ProgressTable(spark, str(tmp_path / "log")) as log:
        got = drain(spark, feats, str(tmp_path / "out"), str(tmp_path / "c1"))
        log.settle(1)
    late = progress.late_rows(progress.read_progress(spark, log.path)).collect()
    assert len(late) >= 6 and sum(r["n_rows"] for r in late) == 600 and not sum(r["n_late"] for r in late)
    want = closed(features(ev), ev)
    assert tidy(got.select(COLS)) == tidy(want.select(COLS))
    last = [f"{s}_last" for s in SIG]
    filled = drain(spark, state.stream_forward_fill(feats.select(keep), "icustay_id", last), str(tmp_path / "fill"), str(tmp_path / "c2"))
    assert rows(filled) == rows(win.forward_fill(want.select(keep), "icustay_id", last))


def test_a_batch_that_dies_between_sinks_is_stored_once(spark, tmp_path):
    ev, path = make_events(spark, 400, 5), str(tmp_path / "in")
    for part in (ev.where("charttime < timestamp'2024-01-01 10:00:00'"), ev.where("charttime >= timestamp'2024-01-01 10:00:00'")):
        add_file(part, path)
    columns, log, ck = ["icustay_id", "window_end_time", "n_events"], str(tmp_path / "log"), str(tmp_path / "ck")
    deaths, epochs = [], []

    def die(batch, epoch):
        epochs.append(epoch)
        if len(deaths) < 2:
            deaths.append(epoch)
            raise RuntimeError("lost between the sinks")

    for _ in range(3):
        write = stream.multi_sink([ledger.append_csv_once(log, columns), die, stream.parquet_by_epoch(str(tmp_path / "f"))])
        try:
            stream.run_available(stream.sink_batches(features(source(spark, path, 1)), write, ck))
        except StreamingQueryException:
            assert deaths
    assert len(deaths) == 2 and len(epochs) > len(set(epochs))
    want = rows(closed(features(ev), ev).select(columns))
    schema = T.StructType.fromDDL("icustay_id bigint, window_end_time timestamp, n_events bigint")
    assert rows(ledger.read_csv_log(spark, log, schema)) == want == rows(spark.read.parquet(str(tmp_path / "f")).select(columns))
    files = sorted((p for p in (tmp_path / "log").rglob("part-*") if "_" not in p.parts[-3][0]), key=str)
    text = "".join(p.read_text() for p in files).splitlines()
    assert text[0] == ",".join(columns) and text.count(text[0]) == 1 and len(text) == len(want) + 1
    assert ledger.read_csv_log(spark, str(tmp_path / "none"), schema).count() == 0


def test_state_survives_a_restart(spark, tmp_path):
    path, last = str(tmp_path / "in"), [f"{s}_last" for s in SIG]
    first, second = make_events(spark, 80, 1), make_events(spark, 80, 2, start=4.0)
    keep = ["icustay_id", "window_start_time", "window_end_time", *last]
    mk = lambda: features(source(spark, path)).select(keep)
    fill = lambda: drain(spark, state.stream_forward_fill(mk(), "icustay_id", last), str(tmp_path / "o1"), str(tmp_path / "c1"))
    number = lambda: drain(spark, state.stream_positions(mk(), "icustay_id"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    add_file(first, path)
    fill(), number()
    add_file(second, path)
    filled, numbered = fill(), number()
    both = first.unionAll(second)
    want = closed(features(both).select(keep), both)
    assert rows(filled) == rows(win.forward_fill(want, "icustay_id", last))
    pos = win.temporal_features(want, "icustay_id").select("icustay_id", "window_start_time", "window_idx", "hours_in_icu")
    assert rows(numbered.select(pos.columns)) == rows(pos)


def test_labels_and_several_sinks(spark, tmp_path):
    ev, path = make_events(spark), str(tmp_path / "in")
    add_file(ev, path)
    co = spark.createDataFrame([(1, 1, at(6)), (2, 0, None)], "icustay_id bigint, sepsis_label int, sepsis_onset_time timestamp")
    src = source(spark, path).withColumn("latency_ms", F.lit(5).cast("bigint"))
    feats = win.sliding_features(src, "icustay_id", "charttime", "signal_name", "valuenum", SIG, latency="latency_ms")
    labelled = stream.attach_label(feats, co, "icustay_id")
    calls = []
    write = stream.multi_sink([
        stream.parquet_by_epoch(str(tmp_path / "f"), ["avg_latency_ms", "min_latency_ms", "max_latency_ms"]),
        stream.latency_csv_by_epoch(str(tmp_path / "l"), "icustay_id"), lambda b, e: calls.append(e)])
    stream.run_available(stream.sink_batches(labelled, write, str(tmp_path / "ck")))
    got = spark.read.parquet(str(tmp_path / "f"))
    assert "avg_latency_ms" not in got.columns and got.count() == closed(features(ev), ev).count()
    assert len(calls) == 1  # the batch that closed no window was skipped
    on = got.where("icustay_id = 1 and label = 1").agg(F.min("window_end_time"), F.max("window_end_time")).first()
    assert on[0] < at(6) and on[1] < at(6)
    log = spark.read.option("header", True).csv(str(tmp_path / "l"))
    assert log.count() == got.count() and log.select("avg_latency_ms").distinct().first()[0] == "5.0"


def test_scoring_a_stream(spark, tmp_path):
    ev, path = make_events(spark), str(tmp_path / "in")
    add_file(ev, path)
    table = win.temporal_features(features(ev), "icustay_id").withColumn("label_6h", (F.col("a_max") > 50).cast("int"))
    cols = ["a_max", "b_max", "window_idx", "hours_in_icu"]
    model = learn.fit_final(table, cols, "label_6h", maxIter=2)
    model.write().save(str(tmp_path / "model"))
    model = learn.load_model(str(tmp_path / "model"))
    seen = []
    run = scoring.score_stream(
        features(source(spark, path)).select("icustay_id", "window_start_time", "window_end_time", "n_events", "a_max", "b_max"),
        "icustay_id", {"6h": model}, str(tmp_path / "p"), str(tmp_path / "ck"), "6h", 0.5, seen.extend)
    stream.run_available(run)
    got = spark.read.parquet(str(tmp_path / "p")).drop("epoch")
    want = closed(table, ev)
    want = scoring.score_windows(want, "icustay_id", {"6h": model}, "6h", 0.5)
    assert tidy(got.select(want.columns)) == tidy(want)
    assert 0 < len(seen) <= 10 and all(r["alert"] == 1 for r in seen)
    assert learn.score(spark.createDataFrame([(1,)], "icustay_id bigint"), model, "s").first()["s"] is not None


def test_windows_turned_sideways_per_batch_are_the_batch(spark, tmp_path):
    """State is kept per signal; each micro-batch turns its closed windows sideways, all signals of a window together."""
    ev, path = make_events(spark, 400, 7).withColumn("latency_ms", F.floor("valuenum")), str(tmp_path / "in")
    ev = ev.withColumn("signal_name", F.when(F.col("valuenum") % 7 == 0, None).when(F.col("valuenum") % 5 == 0, "other").otherwise(F.col("signal_name"))).checkpoint()
    for lo, hi in ((0, 5), (5, 12), (12, 20)):
        time.sleep(1.1)
        ev.where(F.col("charttime").between(at(lo), at(hi - 1e-3))).coalesce(1).write.mode("append").parquet(path)
    args = ["icustay_id", "charttime", "signal_name", "valuenum", SIG]
    source = stream.with_watermark(stream.stream_files(spark, path, ev.schema, "parquet", "*.parquet", max_files=1))
    write = stream.parquet_by_epoch(str(tmp_path / "out"))
    run = stream.sink_batches(
        win.signal_windows(source, *args, latency="latency_ms"), lambda batch, epoch: write(win.widen(batch, "icustay_id", SIG, True), epoch), str(tmp_path / "ck"))
    stream.run_available(run)
    assert len([p for p in (tmp_path / "out").iterdir()]) >= 3
    want = closed(win.sliding_features(ev, *args, latency="latency_ms"), ev)
    got = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    assert got.columns == want.columns and tidy(got) == tidy(want) and want.count() > 20


def test_more_files_make_no_more_replayed_batches(spark, tmp_path, monkeypatch):
    """A table dealt over many files is replayed in six batches or a few more, in the order of time."""
    data = [(i, at(i / 9), i % 3, "view", float(i), "{}") for i in range(300)]
    events = spark.createDataFrame(data, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    made, commit = [], ledger.commit_chunks
    monkeypatch.setattr(ledger, "commit_chunks", lambda *a, **k: made.append(commit(*a, **k)) or made[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    seen = []
    try:
        replay = catalog._replay(spark, str(tmp_path)).select("event_id")
        stream.run_available(stream.sink_batches(replay, lambda b, e: seen.append([r[0] for r in b.collect()]), str(tmp_path / "ck")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    full = [ids for ids in seen if ids]
    assert made[0] >= 20 and 6 <= len(full) <= 12
    assert [i for ids in full for i in sorted(ids)] == list(range(300))
