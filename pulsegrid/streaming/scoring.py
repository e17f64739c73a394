"""Scoring windows while they stream."""

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions.scalar import alert_flag
from pulsegrid.operators.boost import Boosted
from pulsegrid.operators.learn import score
from pulsegrid.operators.report import top_alerts
from pulsegrid.streaming.state import stream_positions
from pulsegrid.streaming.stream import multi_sink, parquet_by_epoch, sink_batches


def score_windows(windows: DataFrame, key: str, models: dict[str, PipelineModel] | Boosted,
                  horizon: str = "6h", threshold: float = fv.ALERT_THRESHOLD) -> DataFrame:
    """All horizon scores and the alert flag of one horizon; models by horizon, or boosted ones of the
    labels label_<horizon>."""
    if isinstance(models, Boosted):
        names = {label: label.replace("label_", "score_") for label in models.labels}
        out = models.score(windows, names)
    else:
        names = {h: f"score_{h}" for h in models}
        out = windows
        for h, name in names.items():
            out = score(out, models[h], name)
    keep = [key, "window_start_time", "window_end_time"]
    keep += [c for c in ("n_events", "avg_latency_ms") if c in windows.columns]
    keep += names.values()
    return out.select(*keep, alert_flag(f"score_{horizon}", threshold).alias("alert"))


def score_stream(stream: DataFrame, key: str, models: dict[str, PipelineModel] | Boosted, path: str,
                 checkpoint: str, horizon: str = "6h", threshold: float = fv.ALERT_THRESHOLD,
                 on_alerts: Callable[[list], None] | None = None) -> StreamingQuery:
    """Position, score and persist streamed windows; the ten highest alerts of each
    batch go to `on_alerts`."""
    write = parquet_by_epoch(path)

    def show(batch: DataFrame, epoch: int) -> None:
        if on_alerts:
            on_alerts(top_alerts(batch, key, f"score_{horizon}").collect())

    def per_batch(batch: DataFrame, epoch: int) -> None:
        scored = score_windows(batch, key, models, horizon, threshold)
        multi_sink([write, show])(scored, epoch)

    return sink_batches(stream_positions(stream, key), per_batch, checkpoint)
