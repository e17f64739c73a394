"""Small frames by hand."""

from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)


def at(hours: float) -> datetime:
    return T0 + timedelta(seconds=round(hours * 3600))


def rows(df, *cols):
    """Rows as a sorted list of tuples, null first."""
    got = [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]
    return sorted(got, key=lambda t: tuple((v is not None, v) for v in t))
