"""Row-level expressions for cleaning, labelling and reporting."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import fixed_values as fv

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- text and time -------------------------------------------------------------

def match_any(col: ColumnOrName, words: list[str]) -> Column:
    """True when any word occurs in the text, ignoring case; null text is False."""
    pattern = "|".join(re.escape(w.lower()) for w in words)
    return F.coalesce(F.lower(_c(col)).rlike(pattern), F.lit(False))


def allow_or_null(col: ColumnOrName, values: list[str]) -> Column:
    """True for an allowed value after upper-casing and trimming, or for null."""
    return _c(col).isNull() | F.upper(F.trim(_c(col))).isin(values)


def parse_time(col: ColumnOrName, fmt: str = fv.TIME_FORMAT) -> Column:
    """Text to timestamp; anything unreadable becomes null."""
    return F.try_to_timestamp(_c(col), F.lit(fmt))


def parse_times(df: DataFrame, cols: list[str], fmt: str = fv.TIME_FORMAT) -> DataFrame:
    """Lenient parse of those listed columns that exist."""
    return df.withColumns({c: parse_time(c, fmt) for c in cols if c in df.columns})


def iso_time(col: ColumnOrName) -> Column:
    return F.date_format(_c(col), fv.TIME_FORMAT)


def to_utc_ntz(df: DataFrame) -> DataFrame:
    """Every timestamp column as zone-less wall clock of the (UTC) session."""
    stamps = [n for n, t in df.dtypes if t == "timestamp"]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in stamps})


def from_ntz(df: DataFrame) -> DataFrame:
    """Every zone-less timestamp column as an instant of the (UTC) session."""
    stamps = [n for n, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in stamps})


def on_boundary(ts: ColumnOrName, minutes: tuple[int, ...] = (0, 30)) -> Column:
    return F.minute(_c(ts)).isin(*minutes)


def hours_between(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    micros = F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))
    return micros / F.lit(3_600_000_000.0)


def plus_hours(ts: ColumnOrName, hours: float) -> Column:
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))


def ceil_hour(ts: ColumnOrName) -> Column:
    """The whole hour at or after the time."""
    floor = F.date_trunc("hour", _c(ts))
    return F.when(floor == _c(ts), floor).otherwise(plus_hours(floor, 1))


# --- numbers -------------------------------------------------------------------

def convert_units(value: ColumnOrName, code: ColumnOrName, codes=fv.FAHRENHEIT_CODES) -> Column:
    """Fahrenheit to Celsius for the tagged codes, everything else untouched."""
    return F.when(_c(code).isin(list(codes)), (_c(value) - 32) * 5 / 9).otherwise(_c(value))


def band(col: ColumnOrName, bands, compare: str, dtype: str = "double") -> Column:
    """Ordered cut points to values; null stays null."""
    cuts, rest = bands
    test = {
        ">": lambda c, t: c > t,
        ">=": lambda c, t: c >= t,
        "<": lambda c, t: c < t,
    }[compare]
    out = F.when(_c(col).isNull(), None)
    for cut, value in cuts:
        out = out.when(test(_c(col), F.lit(cut)), F.lit(value))
    return out.otherwise(F.lit(rest)).cast(dtype)


def spo2_ratio(col: ColumnOrName) -> Column:
    return band(col, fv.SPO2_RATIO_BANDS, ">=")


def score_respiratory(col: ColumnOrName) -> Column:
    return band(col, fv.RESPIRATORY_BANDS, ">")


def score_platelets(col: ColumnOrName) -> Column:
    return band(col, fv.PLATELET_BANDS, ">")


def score_bilirubin(col: ColumnOrName) -> Column:
    return band(col, fv.BILIRUBIN_BANDS, "<")


def score_creatinine(col: ColumnOrName) -> Column:
    return band(col, fv.CREATININE_BANDS, "<")


def score_coma(col: ColumnOrName) -> Column:
    return band(col, fv.COMA_BANDS, ">=")


def score_pressure(pressure: ColumnOrName, flag: ColumnOrName) -> Column:
    """A running pressor wins; otherwise the pressure decides; unknown is null."""
    value = _c(pressure)
    return (
        F.when(F.coalesce(_c(flag), F.lit(False)), F.lit(fv.PRESSOR_SCORE))
        .when(value.isNull(), None)
        .when(value >= fv.PRESSURE_CUT, F.lit(0))
        .otherwise(F.lit(1))
        .cast("double")
    )


def valid_fraction(col: ColumnOrName) -> Column:
    """Percent in (0, 100] as a fraction, anything else null."""
    return F.when((_c(col) > 0) & (_c(col) <= 100), _c(col) / 100.0)


def ratio_or(num: ColumnOrName, den: ColumnOrName, alternative: Column) -> Column:
    """num / den where both are known and den is positive, else the alternative."""
    usable = _c(num).isNotNull() & (_c(den) > 0)
    return F.when(usable, F.try_divide(_c(num), _c(den))).otherwise(alternative)


def row_sum(cols: list[ColumnOrName]) -> Column:
    """Null-skipping sum across columns; all null gives 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0.0)) for c in cols])


def row_count(cols: list[ColumnOrName]) -> Column:
    """How many of the columns are not null."""
    return reduce(lambda a, b: a + b, [_c(c).isNotNull().cast("int") for c in cols])


def ensemble_mean(cols: list[ColumnOrName]) -> Column:
    """Null-skipping mean across columns; all null gives null."""
    return F.try_divide(row_sum(cols), row_count(cols))


# --- labels, flags, categories --------------------------------------------------

def horizon_label(end: ColumnOrName, onset: ColumnOrName, hours: int,
                  positive: ColumnOrName | None = None) -> Column:
    """1 when onset lies in (end, end + hours], for positive entities only."""
    hit = (_c(onset) > _c(end)) & (_c(onset) <= plus_hours(end, hours))
    if positive is not None:
        hit = hit & (_c(positive) == 1)
    return F.when(hit, 1).otherwise(0)


def gap_seconds(end: ColumnOrName, onset: ColumnOrName) -> Column:
    return (F.unix_micros(_c(onset)) - F.unix_micros(_c(end))) / F.lit(1_000_000.0)


def gap_category(end: ColumnOrName, onset: ColumnOrName,
                 hours: int = fv.FIRST_HORIZON_HOURS) -> Column:
    """A exactly on a horizon boundary, B within a minute of one, D no onset, E other."""
    gap, horizon = gap_seconds(end, onset), F.lit(hours * 3600.0)
    return (
        F.when(gap.isNull(), "D")
        .when((gap == 0) | (gap == horizon), "A")
        .when((F.abs(gap) < 60) | (F.abs(gap - horizon) < 60), "B")
        .otherwise("E")
    )


def freshness(cols: list[str], suffix: str = "_last") -> dict[str, Column]:
    """One 0/1 flag per column, named by swapping the suffix for _fresh."""
    return {
        c.removesuffix(suffix) + "_fresh": F.col(c).isNotNull().cast("int") for c in cols
    }


def alert_flag(score: ColumnOrName, threshold: float = fv.ALERT_THRESHOLD) -> Column:
    return F.coalesce((_c(score) >= threshold).cast("int"), F.lit(0))


def hour_bin(index: ColumnOrName, slide_hours: float = 0.5, cap: int = fv.HOUR_BIN_CAP) -> Column:
    return F.least(F.floor(_c(index) * slide_hours), F.lit(cap)).cast("int")


def split_feature(col: ColumnOrName) -> tuple[Column, Column]:
    """Feature name to (signal, statistic), split at the last underscore."""
    pattern = "^(.*)_([^_]+)$"
    return F.regexp_extract(_c(col), pattern, 1), F.regexp_extract(_c(col), pattern, 2)


def standardise(col: ColumnOrName, mean: ColumnOrName, sd: ColumnOrName) -> Column:
    return (_c(col) - _c(mean)) / F.greatest(_c(sd), F.lit(fv.SD_FLOOR))


# --- column sets ------------------------------------------------------------------

def drop_suffix(df: DataFrame, suffixes: list[str] = fv.NOISY_SUFFIXES) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(tuple(suffixes))])


def ensure_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Add the missing ones of these columns as null doubles."""
    return df.withColumns(
        {n: F.lit(None).cast("double") for n in names if n not in df.columns}
    )


def tree_columns(signals: list[str], stats: list[str] = fv.TREE_STATS) -> list[str]:
    return [f"{s}_{t}" for s in signals for t in stats]
