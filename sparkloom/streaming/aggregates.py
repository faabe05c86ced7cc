"""Metrics of a stream: plain aggregates of one view over event-time windows, with late data dropped at a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import QueryError
from sparkloom.operators.render import Scope
from sparkloom.session import Engine

KINDS = ("sum", "count", "average", "min", "max")


def windowed(engine: Engine, stream: DataFrame, metrics: list[str], dimensions: list[str] = (), window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """`stream` stands for the metrics' view, whose default_date is the event time; append or update mode."""
    p = engine.project
    chosen, dims = [p.get_field(m) for m in metrics], [p.get_field(d) for d in dimensions]
    views = {v for f in (*chosen, *dims) for v in f.views()}
    if len(views) != 1 or any(m.type not in KINDS for m in chosen):
        raise QueryError(f"a stream takes {', '.join(KINDS)} of one view")
    view = p.view(views.pop())
    if not view.default_date:
        raise QueryError(f"view {view.name} needs a default_date")
    scope = Scope(p, engine.now())
    time = scope.row(p.get_field(f"{view.name}.{view.default_date}_raw"))
    df = stream.alias(view.name).withColumn("__time", F.expr(time).cast("timestamp")).alias(view.name).withWatermark("__time", watermark)
    by = [F.window("__time", window, slide), *[F.expr(scope.row(d)).alias(d.column) for d in dims]]
    return df.groupBy(*by).agg(*[F.expr(scope.aggregate(m)).alias(m.column) for m in chosen]).withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end")).drop("window")
