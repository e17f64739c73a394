"""The supplied star-schema tables in the roles the operators expect.

`events` plays the measurement stream: user_id is the entity, event_type the
signal, value the reading. Everything else (stays, infusions, a hourly chart, a
cohort, scores) is derived from whole tables by fixed expressions, so an oracle can
derive the same.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulsegrid.functions.fixed_values import STATS
from pulsegrid.operators.labels import horizon_labels, stratified_folds
from pulsegrid.operators.windows import signal_windows, sliding_features, widen
from pulsegrid.sources.readers import read_table

KEY = "user_id"
SIGNALS = ["click", "error", "purchase", "signup", "view"]
LABELS = ["label_6h", "label_12h", "label_24h"]
MODELS = ["m1", "m2"]
IDS = [KEY, "window_start_time", "window_end_time"]
LAST = [f"{s}_last" for s in SIGNALS]

EVENT_FILE = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def of_type(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("event_type") == kind)


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the canonical measurement layout."""
    return events(spark, sf).select(
        F.col("user_id").alias("icustay_id"), F.col("ts").alias("charttime"),
        F.col("event_type").alias("signal_name"), F.col("value").alias("valuenum"),
        F.lit("events").alias("source_table"), "event_id",
    )


def features(df: DataFrame, latency: str | None = None, stats: list[str] = STATS) -> DataFrame:
    return sliding_features(df, KEY, "ts", "event_type", "value", SIGNALS, tie="event_id",
                            latency=latency, stats=stats)


def signal_features(df: DataFrame, latency: str | None = None) -> DataFrame:
    """`features` before they are turned sideways, which `widened` does per micro-batch."""
    return signal_windows(df, KEY, "ts", "event_type", "value", SIGNALS, tie="event_id", latency=latency)


def widened(long: DataFrame, latency: bool = False) -> DataFrame:
    return widen(long, KEY, SIGNALS, latency)


def windows(spark: SparkSession, sf: str, stats: list[str] = STATS) -> DataFrame:
    return features(events(spark, sf), stats=stats)


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user: label 1 and onset at the first error of 100 or more."""
    hit = (F.col("event_type") == "error") & (F.col("value") >= 100)
    return events(spark, sf).groupBy(KEY).agg(
        F.max(hit.cast("int")).alias("sepsis_label"),
        F.min(F.when(hit, F.col("ts"))).alias("sepsis_onset_time"),
    )


def labelled(spark: SparkSession, sf: str, stats: list[str] = STATS) -> DataFrame:
    return horizon_labels(windows(spark, sf, stats), cohort(spark, sf), KEY)


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_folds(cohort(spark, sf), KEY, "sepsis_label")


def _percent(value, top: float):
    """A score in [0, 1] with two decimals, so that many rows tie."""
    return F.floor(F.least(value, F.lit(top)) * (100.0 / top)) / 100.0


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled windows with two deterministic score sets."""
    zero = F.lit(0.0)
    return labelled(spark, sf, ["min", "max", "last"]).select(
        *IDS, *LABELS, "n_events",
        _percent(F.coalesce("error_max", "view_max", zero), 200.0).alias("m1_label_6h"),
        _percent(F.coalesce("click_max", "purchase_max", zero), 100.0).alias("m1_label_12h"),
        _percent(F.coalesce("signup_last", "error_min", zero), 200.0).alias("m1_label_24h"),
        (((F.hour("window_end_time") * 7 + F.col(KEY)) % 20) / 20.0).alias("m2_label_6h"),
        (((F.col("n_events") * 3 + F.minute("window_end_time") + F.col(KEY)) % 10) / 10.0)
        .alias("m2_label_12h"),
        (F.least(F.col("n_events"), F.lit(4)) / 4.0).alias("m2_label_24h"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scored windows in the layout of the live prediction table."""
    return scored(spark, sf).select(
        *IDS, "n_events", F.col("m1_label_6h").alias("score_6h"),
        F.col("m1_label_12h").alias("score_12h"), F.col("m2_label_24h").alias("score_24h"),
        (F.col("m1_label_6h") >= 0.30).cast("int").alias("alert"),
    )


def stays(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals: each signup opens a stay of 6 to 53 hours."""
    hours = F.lit(6) + F.floor("value") % 48
    return of_type(events(spark, sf), "signup").select(
        F.col("event_id").alias("stay_id"), KEY, F.col("ts").alias("intime"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), hours.cast("int"))).alias("outtime"),
    )


def infusions(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals: each error runs for three minutes per unit of value."""
    minutes = F.floor(F.col("value") * 3).cast("int")
    return of_type(events(spark, sf), "error").select(
        KEY, F.col("ts").alias("starttime"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("endtime"),
    )


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """One long stay per user, from the first event to the last."""
    return events(spark, sf).groupBy(KEY).agg(
        F.min("ts").alias("intime"), F.max("ts").alias("outtime")
    )


def chart(spark: SparkSession, sf: str) -> DataFrame:
    """Events as readings for the hourly score: role, value and, for the three-part
    role, the part."""
    k = F.get_json_object("props", "$.k").cast("int")
    whole = F.floor("value")
    role = (
        F.when(F.col("event_type") == "view",
               F.element_at(F.array(F.lit("spo2"), F.lit("map"), F.lit("fio2")), (k % 3) + 1))
        .when(F.col("event_type") == "purchase",
              F.element_at(F.array(*map(F.lit, ["pao2", "platelets", "bilirubin", "creatinine"])),
                           (k % 4) + 1))
        .when(F.col("event_type") == "click",
              F.when(k % 2 == 0, F.lit("coma_total")).otherwise(F.lit("coma_part")))
    )
    reading = (
        F.when(F.col("role") == "spo2", 75 + whole % 25)
        .when(F.col("role") == "map", 40 + whole % 60)
        .when(F.col("role") == "fio2", 21 + whole % 90)
        .when(F.col("role") == "pao2", 40 + whole)
        .when(F.col("role") == "platelets", F.col("value") * 2)
        .when(F.col("role") == "bilirubin", F.col("value") / 10)
        .when(F.col("role") == "creatinine", F.col("value") / 20)
        .when(F.col("role") == "coma_total", 3 + whole % 13)
        .when(F.col("role") == "coma_part", 1 + (whole + F.col("part")) % 5)
    )
    # every fourth code charts all three parts, the others only two
    parts = (
        F.when(F.col("role") != "coma_part", F.array(F.lit(0)))
        .when(k % 4 == 1, F.array(F.lit(1), F.lit(2), F.lit(3)))
        .otherwise(F.array(F.lit(1), F.lit(2)))
    )
    return (
        events(spark, sf).withColumn("role", role).where(F.col("role").isNotNull())
        .withColumn("part", F.explode(parts))
        .select(KEY, "event_id", "ts", "role", "part", reading.cast("double").alias("value"))
    )


def latency_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a latency of ten ms per unit of value."""
    return events(spark, sf).withColumn("latency_ms", F.floor(F.col("value") * 10))
