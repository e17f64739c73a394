"""Registered queries: every operator over the whole supplied tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsegrid.functions import fixed_values as fv, scalar as fx
from pulsegrid.operators import boost, clean, keys, labels, metrics, quality, recurrent, report, timejoin
from pulsegrid.operators import windows as win
from pulsegrid.plans import bindings as b
from pulsegrid.plans.hourly import hourly_score
from pulsegrid.session import scratch_path, stored
from pulsegrid.sources import messages, readers, writers
from pulsegrid.streaming import ledger, progress, scoring, state, stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY, SIGNALS, LABELS, MODELS, IDS, LAST = b.KEY, b.SIGNALS, b.LABELS, b.MODELS, b.IDS, b.LAST
FEATURES = fx.tree_columns(SIGNALS, fv.STATS)
TREE_STATS = fv.TREE_STATS
TREE = fx.tree_columns(SIGNALS)


def tidy(df: DataFrame) -> DataFrame:
    """Six decimals and zone-less times, so that two engines compare equal."""
    df = fx.to_utc_ntz(df)
    return df.select(*[
        (F.round(n, 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes
    ])


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf: tidy(fn(spark, sf))
    return fn


# --- features and labels -----------------------------------------------------------

@query
def sliding_features(spark, sf):
    return b.windows(spark, sf)


@query
def horizon_label(spark, sf):
    side = b.cohort(spark, sf)
    return b.windows(spark, sf).join(side, KEY, "left").select(
        *IDS, fx.horizon_label("window_end_time", "sepsis_onset_time", 6, "sepsis_label").alias("label")
    )


@query
def horizon_labels(spark, sf):
    return b.labelled(spark, sf).select(*IDS, *LABELS)


@query
def window_latency(spark, sf):
    return b.features(b.latency_events(spark, sf), "latency_ms").select(
        *IDS, "avg_latency_ms", "min_latency_ms", "max_latency_ms", "n_events"
    )


@query
def temporal_features(spark, sf):
    grid = stored(b.windows(spark, sf).select(*IDS))
    return win.temporal_features(grid, KEY)


@query
def forward_fill(spark, sf):
    return win.forward_fill(stored(b.windows(spark, sf, ["last"]).select(*IDS, *LAST)), KEY, LAST)


@query
def fill_and_impute(spark, sf):
    table = stored(b.windows(spark, sf, ["last"]).select(*IDS, *LAST))
    return labels.fill_and_impute(table, stored(b.folds(spark, sf)), KEY, LAST)


@query
def sequence_features(spark, sf):
    table = stored(b.labelled(spark, sf, ["last"]).select(*IDS, *LABELS, *LAST))
    return labels.sequence_features(table, stored(b.folds(spark, sf)), KEY, SIGNALS, LABELS)


@query
def tree_features(spark, sf):
    return labels.tree_features(b.labelled(spark, sf, TREE_STATS), KEY, SIGNALS, LABELS)


@query
def drop_suffix(spark, sf):
    return fx.drop_suffix(b.windows(spark, sf))


@query
def last_n(spark, sf):
    return win.last_n(stored(b.windows(spark, sf).select(*IDS, "n_events")), KEY, 50)


@query
def lagged(spark, sf):
    table = stored(b.windows(spark, sf).select(*IDS, "n_events"))
    return win.lagged(table, KEY, ["n_events"], [1, 2, 3])


@query
def freshness(spark, sf):
    return b.windows(spark, sf, ["last"]).select(*IDS, *LAST).withColumns(fx.freshness(LAST)).drop(*LAST)


def _sequences(spark, sf):
    table = stored(b.labelled(spark, sf, ["last"]).select(*IDS, *LABELS, *LAST))
    return win.sequence_table(table, KEY, LAST, LABELS)


@query
def sequence_table(spark, sf):
    steps = _sequences(spark, sf).select(
        KEY, "seq_len", F.posexplode(F.arrays_zip("times", "x", "y")).alias("step", "_s")
    )
    return steps.select(
        KEY, "seq_len", "step", F.col("_s.times").alias("window_start_time"),
        *[F.col("_s.x")[i].alias(c) for i, c in enumerate(LAST)],
        *[F.col("_s.y")[i].alias(c) for i, c in enumerate(LABELS)],
    )


@query
def pad_sequences(spark, sf):
    padded = win.pad_sequences(_sequences(spark, sf), 320, len(LAST), len(LABELS))
    return padded.select(
        KEY, "seq_len", F.size("x").alias("padded_len"),
        F.size(F.filter("mask", lambda m: m)).alias("n_real"),
        F.element_at("x", -1)[0].alias("last_click"), F.element_at("x", 1)[0].alias("first_click"),
        F.element_at("mask", 1).alias("first_real"),
    )


# --- cleaning ------------------------------------------------------------------------

def _dimension(spark):
    rows = [("click", "heart_rate", "monitor"), ("view", "map", "monitor"),
            ("error", "lactate", "lab"), ("purchase", "wbc", "lab")]
    return spark.createDataFrame(rows, "event_type string, signal_name string, source_tag string")


def _bounds(spark):
    rows = [("click", 5.0, 100.0), ("view", 1.0, 50.0), ("error", 0.5, 200.0)]
    return spark.createDataFrame(rows, "event_type string, lo double, hi double")


@query
def map_codes(spark, sf):
    mapped = clean.map_codes(b.events(spark, sf), _dimension(spark), "event_type")
    return mapped.select("event_id", "signal_name", "source_tag", "value")


@query
def keep_codes(spark, sf):
    return clean.scan_codes(
        b.events(spark, sf), "event_type", ["click", "error"], ["event_id", "event_type", "value"]
    )


@query
def keep_ids(spark, sf):
    positive = b.cohort(spark, sf).where(F.col("sepsis_label") == 1)
    return clean.keep_ids(b.events(spark, sf), positive, KEY).select("event_id", KEY)


@query
def drop_incomplete(spark, sf):
    table = b.windows(spark, sf, ["mean"]).select(*IDS, "click_mean", "view_mean")
    return clean.drop_incomplete(table, ["click_mean", "view_mean"])


@query
def incomplete_counts(spark, sf):
    return clean.incomplete_counts(b.windows(spark, sf, ["mean"]), ["click_mean", "view_mean"])


@query
def convert_units(spark, sf):
    return b.events(spark, sf).select(
        "event_id", fx.convert_units("value", "event_type", ["error", "view"]).alias("value")
    )


@query
def apply_bounds(spark, sf):
    kept = clean.apply_bounds(b.events(spark, sf), _bounds(spark), "event_type", "value")
    return kept.select("event_id", "event_type", "value")


@query
def bounds_report(spark, sf):
    return clean.bounds_report(b.events(spark, sf), _bounds(spark), "event_type", "value")


@query
def coverage(spark, sf):
    mapped = clean.map_codes(b.events(spark, sf), _dimension(spark), "event_type")
    return clean.coverage(mapped, ["signal_name", "source_tag"])


@query
def match_any(spark, sf):
    words = ["license", "copyright", "password", "e-mail"]
    return readers.read_table(spark, sf, "documents").select(
        "doc_id", fx.match_any("text", words).alias("matched")
    )


@query
def allow_or_null(spark, sf):
    kept = readers.read_table(spark, sf, "orders").where(
        fx.allow_or_null("o_orderpriority", ["1-URGENT", "2-HIGH"])
    )
    return kept.select("o_orderkey", "o_orderpriority")


@query
def parse_times(spark, sf):
    """Text times, one in five of them unreadable, parsed leniently."""
    text = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(fx.iso_time("ts"))
    return fx.parse_times(b.events(spark, sf).select("event_id", text.alias("t")), ["t"])


@query
def fallback_time(spark, sf):
    precise = F.when(F.col("event_type") != "view", F.col("ts"))
    return b.events(spark, sf).select(
        "event_id", F.coalesce(precise, F.date_trunc("day", "ts")).alias("t")
    )


@query
def band_scores(spark, sf):
    v = F.col("value")
    return b.events(spark, sf).select(
        "event_id", fx.spo2_ratio(v).alias("spo2_ratio"),
        fx.score_respiratory(v * 5).alias("resp"), fx.score_platelets(v).alias("platelets"),
        fx.score_bilirubin(v / 10).alias("bilirubin"), fx.score_creatinine(v / 20).alias("creatinine"),
        fx.score_coma(v / 5).alias("coma"),
        fx.score_pressure(F.when(F.col("event_type") != "view", v), F.col("event_type") == "error")
        .alias("pressure"),
        fx.valid_fraction(v).alias("fraction"),
        fx.ratio_or(F.lit(80.0), fx.valid_fraction(v), fx.spo2_ratio(v)).alias("ratio"),
    )


@query
def row_sum(spark, sf):
    cols = [f"{s}_mean" for s in SIGNALS]
    return b.windows(spark, sf, ["mean"]).select(
        *IDS, fx.row_sum(cols).alias("total"), fx.row_count(cols).alias("n_parts"),
        fx.ensemble_mean(cols).alias("mean"),
    )


@query
def json_roundtrip(spark, sf):
    made = messages.encode_events(b.canonical(spark, sf), F.unix_millis("charttime"))
    decoded = messages.decode_events(made)
    late = messages.with_latency(decoded, F.col("producer_timestamp_ms") + F.floor(F.col("valuenum") * 10))
    return late.drop("processing_timestamp_ms")


# --- split ---------------------------------------------------------------------------

@query
def split_ordered(spark, sf):
    return writers.split_ordered(
        b.events(spark, sf).select("event_id", "ts"), ["ts", "event_id"], 50
    )


@query
def split_manifest(spark, sf):
    rows = b.events(spark, sf).select("event_id", "ts")
    return writers.split_manifest(writers.split_ordered(rows, ["ts", "event_id"], 50), "ts")


@query
def manifest_totals(spark, sf):
    rows = b.events(spark, sf).select("event_id", "ts", "event_type")
    totals = writers.manifest_totals(
        writers.split_ordered(rows, ["ts", "event_id"], 50), "ts", "event_type"
    )
    return totals.withColumn("signals", F.array_join("signals", ","))


@query
def split_roundtrip(spark, sf):
    """Write the canonical split as CSV, read it back, count per signal."""
    rows = b.canonical(spark, sf)
    chunks = writers.split_ordered(rows, ["charttime", "event_id"], 50).drop("event_id")
    path = scratch_path(spark, "stream-input")
    writers.write_split(chunks, path, ["charttime"])
    back = readers.read_events(spark, path)
    return back.groupBy("signal_name").agg(
        F.count("*").alias("n"), F.min("charttime").alias("first"), F.max("charttime").alias("last"),
        F.sum(F.round(F.col("valuenum") * 100).cast("long")).alias("cents"),
    )


# --- joins in time ---------------------------------------------------------------------

@query
def first_stay(spark, sf):
    stays = b.stays(spark, sf)
    return win.first_by(stays, [KEY], "intime", "stay_id")


@query
def first_stay_join(spark, sf):
    first = win.first_by(b.stays(spark, sf), [KEY], "intime", "stay_id")
    return b.of_type(b.events(spark, sf), "purchase").join(first, KEY).select(
        "event_id", KEY, "stay_id"
    )


@query
def pair_events(spark, sf):
    rows = b.events(spark, sf)
    return timejoin.pair_events(b.of_type(rows, "click"), b.of_type(rows, "view"), KEY, "ts")


@query
def assign_interval(spark, sf):
    points = b.of_type(b.events(spark, sf), "purchase").select("event_id", KEY, "ts")
    return timejoin.assign_interval(
        points, b.stays(spark, sf), KEY, "ts", "stay_id", "intime", "outtime"
    )


@query
def hourly_spine(spark, sf):
    return timejoin.hourly_spine(b.spans(spark, sf), KEY, "intime", "outtime")


@query
def covered_flag(spark, sf):
    grid = timejoin.hourly_spine(b.spans(spark, sf), KEY, "intime", "outtime")
    return timejoin.covered_flag(grid, b.infusions(spark, sf), KEY, "starttime", "endtime")


@query
def bucket_flag(spark, sf):
    grid = timejoin.hourly_spine(b.spans(spark, sf), KEY, "intime", "outtime")
    return timejoin.bucket_flag(grid, b.of_type(b.events(spark, sf), "signup"), KEY, "ts")


@query
def hourly_last(spark, sf):
    return timejoin.hourly_last(b.of_type(b.events(spark, sf), "click"), KEY, "ts", "value", "event_id")


@query
def asof_fill(spark, sf):
    grid = timejoin.hourly_spine(b.spans(spark, sf), KEY, "intime", "outtime")
    filled = timejoin.asof_fill(
        grid, b.events(spark, sf), KEY, "ts", "event_type", "value", ["purchase", "view"], "event_id"
    )
    return filled.withColumnsRenamed({"purchase": "purchase_known", "view": "view_known"})


@query
def sum_parts(spark, sf):
    parts = b.chart(spark, sf).where(F.col("role") == "coma_part")
    return timejoin.sum_parts(parts, KEY, "ts", "part", "value")


def _hourly(spark, sf):
    return hourly_score(
        b.spans(spark, sf), b.chart(spark, sf), b.infusions(spark, sf),
        b.of_type(b.events(spark, sf), "signup"), KEY, "ts", "event_id",
    )


@query
def hourly_score_table(spark, sf):
    return _hourly(spark, sf)


def _refs(spark, sf):
    rows = b.events(spark, sf)
    return timejoin.pair_events(
        b.of_type(rows, "click"), b.of_type(rows, "view"), KEY, "ts", name="ref_time"
    )


@query
def baseline_value(spark, sf):
    refs = _refs(spark, sf).join(b.spans(spark, sf), KEY)
    return labels.baseline_value(_hourly(spark, sf), refs, KEY, "hour", "sofa", "intime", "ref_time")


@query
def first_rise(spark, sf):
    series = stored(_hourly(spark, sf).select(KEY, "hour", "sofa"))
    refs = stored(_refs(spark, sf).join(b.spans(spark, sf), KEY))
    base = labels.baseline_value(series, refs, KEY, "hour", "sofa", "intime", "ref_time")
    return labels.first_rise(series, refs.join(base, KEY), KEY, "hour", "sofa", "ref_time")


def _labelled_entities(spark, sf):
    series = stored(_hourly(spark, sf).select(KEY, "hour", "sofa"))
    return labels.label_entities(
        stored(b.spans(spark, sf)), series, _refs(spark, sf), KEY, "hour", "sofa", "intime", "ref_time"
    )


@query
def label_entities(spark, sf):
    return _labelled_entities(spark, sf)


@query
def cohort_funnel(spark, sf):
    return quality.cohort_funnel(_labelled_entities(spark, sf))


@query
def gate(spark, sf):
    return quality.gate(_labelled_entities(spark, sf))


# --- folds and leave-one-fold-out --------------------------------------------------------

@query
def stratified_folds(spark, sf):
    return b.folds(spark, sf)


@query
def fold_table(spark, sf):
    return labels.fold_table(
        b.cohort(spark, sf), b.labelled(spark, sf), stored(b.folds(spark, sf)), KEY,
        "sepsis_label", "label_6h",
    )


@query
def class_weight(spark, sf):
    return labels.class_weight(b.labelled(spark, sf), LABELS)


@query
def lofo_median(spark, sf):
    return labels.lofo_median(b.windows(spark, sf, ["last"]), b.folds(spark, sf), KEY, LAST)


@query
def lofo_moments(spark, sf):
    return labels.lofo_moments(b.windows(spark, sf, ["last"]), b.folds(spark, sf), KEY, LAST)


@query
def standardised(spark, sf):
    table, folds = stored(b.windows(spark, sf, ["last"]).select(*IDS, *LAST)), stored(b.folds(spark, sf))
    moments = labels.lofo_moments(table, folds, KEY, LAST)
    return labels.standardised(table, folds, KEY, LAST, moments)


@query
def leakage_check(spark, sf):
    table, folds = stored(b.windows(spark, sf, ["last"]).select(KEY, *LAST)), stored(b.folds(spark, sf))
    medians = labels.lofo_median(table, folds, KEY, LAST)
    return labels.leakage_check(table, folds, KEY, LAST, medians)


# --- keys and reconciliation ---------------------------------------------------------------

@query
def dedupe(spark, sf):
    hours = b.events(spark, sf).select(KEY, F.date_trunc("hour", "ts").alias("hour"))
    return keys.dedupe(hours, [KEY, "hour"])


def _two_key_sets(spark, sf):
    of = lambda table, column: spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(column).alias(KEY))
    return of("documents", "doc_id"), of("labels", "doc_id")


@query
def common_keys(spark, sf):
    return keys.common_keys(*_two_key_sets(spark, sf), KEY)


@query
def key_diff(spark, sf):
    return keys.key_diff(*_two_key_sets(spark, sf), [KEY])


@query
def overlap_funnel(spark, sf):
    return keys.overlap_funnel(*_two_key_sets(spark, sf), KEY)


def _two_label_sets(spark, sf):
    """The label as it is, and as a reader one hour off in time zone would see it."""
    table = b.windows(spark, sf).select(*IDS).join(b.cohort(spark, sf), KEY, "left")
    late = fx.plus_hours("window_end_time", 1)
    right = table.select(*IDS, fx.horizon_label("window_end_time", "sepsis_onset_time", 6).alias("label_a"),
                         "sepsis_onset_time")
    wrong = table.select(KEY, "window_start_time",
                         fx.horizon_label(late, "sepsis_onset_time", 6).alias("label_b"))
    return right, wrong, [KEY, "window_start_time"]


@query
def reconcile(spark, sf):
    right, wrong, on = _two_label_sets(spark, sf)
    return keys.reconcile(right, wrong, on, "label_a", "label_b").withColumns({
        "gap_seconds": fx.gap_seconds("window_end_time", "sepsis_onset_time"),
        "category": fx.gap_category("window_end_time", "sepsis_onset_time"),
    })


@query
def reconcile_counts(spark, sf):
    right, wrong, on = _two_label_sets(spark, sf)
    return keys.reconcile_counts(right, wrong, on, "label_a", "label_b")


@query
def gap_category(spark, sf):
    table = b.windows(spark, sf).select(*IDS).join(b.cohort(spark, sf), KEY, "left")
    tagged = table.select(
        fx.gap_category("window_end_time", "sepsis_onset_time").alias("category"),
        fx.on_boundary("window_end_time").alias("on_half_hour"),
    )
    return tagged.groupBy("category", "on_half_hour").agg(F.count("*").alias("n"))


@query
def sample_per_group(spark, sf):
    rows = b.events(spark, sf).select("event_id", "event_type", "ts")
    return keys.sample_per_group(rows, "event_type", ["ts", "event_id"], 5)


@query
def union_events(spark, sf):
    """Two aligned event tables as one, globally ordered by time."""
    rows = b.events(spark, sf).select("event_id", "ts", "value")
    first = b.of_type(b.events(spark, sf), "click").select("event_id", "ts", "value", F.lit("a").alias("src"))
    rest = b.events(spark, sf).where("event_type <> 'click'").select(*rows.columns, F.lit("b").alias("src"))
    return first.unionByName(rest).orderBy("ts", "event_id")


# --- quality ---------------------------------------------------------------------------------

@query
def group_share(spark, sf):
    return quality.group_share(b.labelled(spark, sf), ["label_6h"])


@query
def size_stats(spark, sf):
    return quality.size_stats(b.windows(spark, sf), KEY)


@query
def histogram(spark, sf):
    sizes = b.windows(spark, sf).groupBy(KEY).agg(F.count("*").alias("n"))
    return quality.histogram(stored(sizes), "n", None)


@query
def describe(spark, sf):
    return quality.describe(b.events(spark, sf), "value")


@query
def latency_percentiles(spark, sf):
    return quality.latency_summary(b.features(b.latency_events(spark, sf), "latency_ms"))


@query
def null_rates(spark, sf):
    return quality.null_rates(b.windows(spark, sf), FEATURES)


@query
def null_by_stat(spark, sf):
    return quality.null_by_stat(quality.null_rates(b.windows(spark, sf), FEATURES))


@query
def null_delta(spark, sf):
    return quality.null_delta(quality.null_rates(b.windows(spark, sf), FEATURES))


@query
def range_check(spark, sf):
    flags = b.windows(spark, sf, ["last"]).select(*LAST).withColumns(fx.freshness(LAST))
    limits = spark.createDataFrame(
        [("click", 5.0, 25.0), ("view", 85.0, 95.0), ("error", 0.0, 21.0)],
        "signal string, lo double, hi double",
    )
    return quality.range_check(flags, limits)


@query
def covered_rows(spark, sf):
    return quality.covered_rows(b.windows(spark, sf), [f"{s}_slope" for s in SIGNALS])


@query
def late_report(spark, sf):
    latest = b.events(spark, sf).agg(F.max("ts")).scalar()
    return quality.late_report(b.windows(spark, sf), latest)


# --- risk reports ------------------------------------------------------------------------------

@query
def entity_risk(spark, sf):
    return report.entity_risk(b.predictions(spark, sf), KEY)


@query
def alert_rate(spark, sf):
    return report.alert_rate(stored(b.predictions(spark, sf)), KEY)


@query
def top_alerts(spark, sf):
    return report.top_alerts(b.predictions(spark, sf), KEY)


@query
def top_entities(spark, sf):
    return report.top_entities(b.predictions(spark, sf), KEY)


@query
def top_trajectory(spark, sf):
    return report.top_trajectory(stored(b.predictions(spark, sf)), KEY)


@query
def run_summary(spark, sf):
    return report.run_summary(b.predictions(spark, sf), KEY)


@query
def label_prevalence(spark, sf):
    return report.label_prevalence(b.labelled(spark, sf), LABELS)


@query
def score_histogram(spark, sf):
    return quality.histogram(stored(b.predictions(spark, sf).select("score_6h")), "score_6h", 50)


@query
def score_drift(spark, sf):
    table = stored(b.scored(spark, sf).select("m1_label_6h", "m2_label_6h"))
    return quality.score_drift(table, table, "m1_label_6h", "m2_label_6h")


@query
def throughput(spark, sf):
    rows = b.latency_events(spark, sf).select(
        F.unix_millis("ts").alias("produced"), (F.unix_millis("ts") + F.col("latency_ms")).alias("written")
    )
    return report.throughput(rows, "produced", "written")


# --- ranking metrics -----------------------------------------------------------------------------

def _long(spark, sf):
    return metrics.long_scores(b.scored(spark, sf), [KEY], MODELS, LABELS)


GROUPS = ["model", "label"]


@query
def ensemble(spark, sf):
    table = stored(b.scored(spark, sf))
    first = table.select(*IDS, *LABELS, *[f"m1_{l}" for l in LABELS])
    second = table.select(*IDS, *[f"m2_{l}" for l in LABELS])
    return metrics.ensemble(first, second, IDS, "m1", "m2", LABELS)


@query
def roc_points(spark, sf):
    return metrics.roc_points(_long(spark, sf), GROUPS, "y", "score")


@query
def pr_points(spark, sf):
    return metrics.pr_points(_long(spark, sf), GROUPS, "y", "score")


@query
def auroc(spark, sf):
    return metrics.auroc(_long(spark, sf), GROUPS, "y", "score")


@query
def average_precision(spark, sf):
    return metrics.average_precision(_long(spark, sf), GROUPS, "y", "score")


@query
def sens_at_spec(spark, sf):
    return metrics.sens_at_spec(_long(spark, sf), GROUPS, "y", "score")


@query
def threshold_at_spec(spark, sf):
    return metrics.threshold_at_spec(_long(spark, sf), GROUPS, "y", "score")


@query
def metric_table(spark, sf):
    return metrics.metric_table(_long(spark, sf), GROUPS, "y", "score")


@query
def fold_metrics(spark, sf):
    scored = b.scored(spark, sf).join(b.folds(spark, sf).select(KEY, "fold"), KEY)
    rows = metrics.long_scores(scored, ["fold"], MODELS, LABELS)
    return metrics.metric_table(rows, [*GROUPS, "fold"], "y", "score")


@query
def ap_lift(spark, sf):
    return metrics.ap_lift(metrics.metric_table(_long(spark, sf), GROUPS, "y", "score")).select(
        *GROUPS, "prevalence", "lift"
    )


def _leads(spark, sf):
    return metrics.lead_times(b.scored(spark, sf), b.cohort(spark, sf), KEY, "m1_label_6h", 0.3)


@query
def lead_times(spark, sf):
    return _leads(spark, sf)


@query
def lead_summary(spark, sf):
    return metrics.lead_summary(stored(_leads(spark, sf)), b.cohort(spark, sf))


@query
def ecdf(spark, sf):
    return labels.ordered_ecdf(_leads(spark, sf).select(KEY, "lead_hours"), "lead_hours", KEY)


@query
def value_ecdf(spark, sf):
    return labels.ordered_ecdf(b.events(spark, sf).select("event_id", "value"), "value", "event_id")


@query
def bootstrap_ci(spark, sf):
    return metrics.bootstrap_ci(_long(spark, sf), GROUPS, "y", "score")


@query
def cluster_bootstrap(spark, sf):
    """Intervals when whole entities are drawn, and not windows."""
    return metrics.bootstrap_ci(_long(spark, sf), GROUPS, "y", "score", cluster=KEY)


# --- learners ----------------------------------------------------------------------------------------

def _training(spark, sf, stats=TREE_STATS):
    columns = fx.tree_columns(SIGNALS, stats)
    table = stored(b.labelled(spark, sf, stats).select(*IDS, *LABELS, *columns, "n_events"))
    return win.temporal_features(table, KEY), stored(b.folds(spark, sf))


POSITION = ["window_idx", "window_idx_norm", "hours_in_icu"]


def _fold_rows(spark, sf):
    table, folds = _training(spark, sf)
    return stored(table.join(folds.select(KEY, "fold"), KEY), "fold-rows")


def _oof_boosted(rows):
    """Out-of-fold scores of all labels, and the number of trees that each fold's model uses."""
    fitted = boost.fit_folds(rows, TREE + POSITION, LABELS)
    scored = fitted.score(rows.select(*IDS, *LABELS, "fold", *TREE, *POSITION), {l: f"xgb_{l}" for l in LABELS}, "fold")
    used = {(fitted.labels[m.label], m.held): m.best for m in fitted.models}
    trees = {l: F.element_at(F.array(*[F.lit(used[l, j]) for j in range(fv.FOLDS)]), F.col("fold") + 1) for l in LABELS}
    return scored.select(*IDS, *LABELS, "fold", *[f"xgb_{l}" for l in LABELS], *[trees[l].alias(f"trees_{l}") for l in LABELS])


@query
def oof_boosted(spark, sf):
    return _oof_boosted(_fold_rows(spark, sf))


@query
def tuning_rungs(spark, sf):
    """Successive halving over depths, steps and leaf sizes: what each rung gave and kept."""
    grid = [boost.Settings(depth=d, step=s, min_weight=w, rounds=90) for d in (3, 4, 5) for s in (0.03, 0.1, 0.3) for w in (1.0, 10.0)]
    _, rungs = boost.halving_search(_fold_rows(spark, sf), TREE + POSITION, "label_24h", grid)
    made = spark.createDataFrame(rungs, "rung int, rounds int, setting int, judged double, kept boolean")
    settings = spark.createDataFrame([(i, s.depth, s.step, s.min_weight) for i, s in enumerate(grid)],
                                     "setting int, depth int, step double, min_weight double")
    return made.join(settings, "setting")


@query
def oof_sequence(spark, sf):
    """Out-of-fold scores of all labels by a recurrent network over whole sequences."""
    table, folds = _training(spark, sf, ["last"])
    feats = LAST + [f"{s}_fresh" for s in SIGNALS] + ["window_idx_norm"]
    flagged = stored(table.withColumns(fx.freshness(LAST)).select(*IDS, *LABELS, *feats))
    filled = stored(labels.fill_and_impute(flagged, folds, KEY, LAST))
    scaled = labels.standardised(filled, folds, KEY, LAST, labels.lofo_moments(filled, folds, KEY, LAST))
    return recurrent.out_of_fold(scaled, folds, KEY, feats, LABELS)


@query
def importance_table(spark, sf):
    fitted = boost.fit_all(_fold_rows(spark, sf), TREE + POSITION, LABELS)
    return report.top_importance(boost.importance_table(spark, fitted))


# --- streams ---------------------------------------------------------------------------------------------

def _event_stream(spark, sf):
    raw = stream.stream_files(spark, sf, b.EVENT_FILE, "parquet", "events.parquet")
    return stream.with_watermark(raw, "ts")


def _replay(spark, sf, chunks=6):
    """Events in order of time, replayed chunk by chunk. Larger tables make more files; a micro-batch takes as many
    as leave one for each chunk at least, so that their number does not grow with the files."""
    path = scratch_path(spark, "replay")
    split = writers.split_ordered(b.events(spark, sf), ["ts", "event_id"], chunks)
    files = ledger.commit_chunks(split, path, ["ts", "event_id"])
    raw = stream.stream_files(spark, path, b.EVENT_FILE, "parquet", "*.parquet", max_files=max(1, files // chunks))
    return stream.with_watermark(raw, "ts")


@query
def stream_replay(spark, sf):
    """Window features out of a run of six micro-batches or more, in which nothing comes too late."""
    path = scratch_path(spark, "stream-replay")
    write = stream.parquet_by_epoch(path)
    with progress.ProgressTable(spark, scratch_path(spark, "progress")) as log:
        stream.run_available(stream.sink_batches(
            b.signal_features(_replay(spark, sf)), lambda batch, epoch: write(b.widened(batch), epoch),
            stream.checkpoint_for(spark, "stream-replay")))
        log.settle(1)
    batches = progress.late_rows(progress.read_progress(spark, log.path)).agg(
        F.count("*").alias("n"), F.sum("n_late").alias("late")).first()
    if batches["n"] < 6 or batches["late"]:
        raise ValueError(f"{batches['n']} batches, {batches['late']} late rows")
    return spark.read.parquet(path).drop("epoch")


@query
def arrival_losses(spark, sf):
    """Events arriving in order of value and not of time, a bounded run for each power of two: the rows
    that the watermark of a deduplicating stream drops, as its operators tell."""
    rows = b.events(spark, sf).withColumn("chunk", F.floor(F.log2(F.col("value") + 1)).cast("int"))
    inbox, path = scratch_path(spark, "inbox"), scratch_path(spark, "arrived")
    checkpoint = stream.checkpoint_for(spark, "arrivals")
    runs = []

    def drain():
        raw = stream.stream_files(spark, inbox, b.EVENT_FILE, "parquet", "*.parquet")
        once = stream.with_watermark(raw, "ts").dropDuplicates(["event_id", "ts"])
        stream.run_available(stream.sink_parquet(once, path, checkpoint))
        runs.append(1)

    with progress.ProgressTable(spark, scratch_path(spark, "progress")) as log:
        ledger.commit_chunks(rows, inbox, ["ts", "event_id"], after=drain)
        log.settle(len(runs))
    told = progress.late_rows(progress.read_progress(spark, log.path))
    kept = spark.read.parquet(path).count()
    number = (F.row_number().over(Window.orderBy("batch")) - 1).cast("long")  # one row per run
    return told.select(number.alias("run"), "n_rows", "n_late").withColumn("n_kept", F.lit(kept).cast("long"))


def _drained(spark, windows_stream, name):
    path = scratch_path(spark, name)
    stream.run_available(stream.sink_parquet(windows_stream, path, stream.checkpoint_for(spark, name)))
    return spark.read.parquet(path)


@query
def stream_features(spark, sf):
    return _drained(spark, b.features(_event_stream(spark, sf)), "stream-features")


@query
def stream_labelled(spark, sf):
    cohort = stored(b.cohort(spark, sf), "cohort")
    labelled = stream.attach_label(b.features(_event_stream(spark, sf)), cohort, KEY)
    return _drained(spark, labelled.select(*IDS, "label"), "stream-labelled")


@query
def stream_multi_sink(spark, sf):
    """Features and latency rows from one pass over each micro-batch."""
    latency = _event_stream(spark, sf).withColumn("latency_ms", F.floor(F.col("value") * 10))
    features_path, latency_path = (scratch_path(spark, n) for n in ("features", "latency"))
    writer = stream.multi_sink([
        stream.parquet_by_epoch(
            features_path, ["avg_latency_ms", "min_latency_ms", "max_latency_ms"]
        ),
        stream.latency_csv_by_epoch(latency_path, KEY),
    ])
    run = stream.sink_batches(
        b.signal_features(latency, "latency_ms"), lambda batch, epoch: writer(b.widened(batch, True), epoch),
        stream.checkpoint_for(spark, "multi")
    )
    stream.run_available(run)
    kept = spark.read.parquet(features_path).select(*IDS, "n_events")
    log = spark.read.option("header", True).schema(
        "user_id bigint, window_end_time timestamp, avg_latency_ms double, min_latency_ms bigint,"
        "max_latency_ms bigint, n_events bigint, throughput_per_window bigint"
    ).csv(latency_path).drop("n_events", "epoch")
    return kept.join(log, [KEY, "window_end_time"]).select(
        *IDS, "n_events", "avg_latency_ms", "max_latency_ms", "throughput_per_window"
    )


@query
def stream_forward_fill(spark, sf):
    table = b.features(_event_stream(spark, sf), stats=["last"]).select(*IDS, *LAST)
    return _drained(spark, state.stream_forward_fill(table, KEY, LAST), "stream-fill")


@query
def stream_positions(spark, sf):
    table = b.features(_event_stream(spark, sf)).select(*IDS, "n_events")
    return _drained(spark, state.stream_positions(table, KEY), "stream-positions")


@query
def stream_scored(spark, sf):
    models = boost.fit_all(_fold_rows(spark, sf), TREE + ["window_idx", "hours_in_icu"], LABELS)
    path = scratch_path(spark, "predictions")
    windows = b.features(_event_stream(spark, sf), stats=TREE_STATS).select(*IDS, *TREE, "n_events")
    run = scoring.score_stream(windows, KEY, models, path, stream.checkpoint_for(spark, "scoring"))
    stream.run_available(run)
    return spark.read.parquet(path).drop("epoch")


@query
def windows_report(spark, sf):
    """The post-run tables over a stored window sink, as one long table."""
    table = stored(b.labelled(spark, sf))
    made = report.windows_report(table, KEY, "label_6h", FEATURES)
    by_label = made["labels"].select(
        F.concat(F.lit("label="), F.col("label_6h").cast("string")).alias("item"),
        F.col("n_rows").cast("double").alias("value"),
    )
    flat = lambda df: df.select([F.col(c).cast("double").alias(c) for c in df.columns])
    one_row = lambda df: flat(df).unpivot([], df.columns, "item", "value")
    return by_label.unionByName(one_row(made["sizes"])).unionByName(one_row(made["coverage"]))
