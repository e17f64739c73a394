"""Declared schemas of the files and messages this package reads."""

from pyspark.sql import types as T


def _fields(*pairs):
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_LONG, _INT, _DBL, _STR, _TS = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType(),
)

STAYS = _fields(
    ("icustay_id", _LONG), ("subject_id", _LONG), ("hadm_id", _LONG),
    ("intime", _TS), ("outtime", _TS), ("los", _DBL), ("dbsource", _STR),
)
PRESCRIPTIONS = _fields(
    ("hadm_id", _LONG), ("icustay_id", _LONG), ("drug", _STR), ("route", _STR),
    ("startdate", _TS),
)
CULTURES = _fields(
    ("hadm_id", _LONG), ("spec_type_desc", _STR), ("charttime", _TS), ("chartdate", _TS),
)
CHART_EVENTS = _fields(
    ("icustay_id", _LONG), ("itemid", _INT), ("charttime", _TS), ("valuenum", _DBL),
)
LAB_EVENTS = _fields(
    ("hadm_id", _LONG), ("itemid", _INT), ("charttime", _TS), ("valuenum", _DBL),
)
INFUSION_INTERVALS = _fields(
    ("icustay_id", _LONG), ("itemid", _INT), ("starttime", _TS), ("endtime", _TS),
)
INFUSION_POINTS = _fields(
    ("icustay_id", _LONG), ("itemid", _INT), ("charttime", _TS),
)
EVENT = _fields(
    ("icustay_id", _LONG), ("charttime", _TS), ("signal_name", _STR),
    ("valuenum", _DBL), ("source_table", _STR),
)
MESSAGE = _fields(
    ("icustay_id", _LONG), ("charttime", _STR), ("signal_name", _STR),
    ("valuenum", _DBL), ("source_table", _STR), ("producer_timestamp_ms", _LONG),
)
