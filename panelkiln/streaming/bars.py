"""Daily bars of a stream of events, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, ts_col: str = "ts", ticker_col: str = "event_type", value_col: str = "value", tie_col: str = "event_id", late: str = "1 day") -> DataFrame:
    """A bar per day and ticker as sources.panels.events_daily has it, each written once its day is past the watermark. Events later than `late` are left out."""
    at = F.struct(ts_col, tie_col)
    out = (
        events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late).groupBy(F.window(ts_col, "1 day").alias("_w"), F.col(ticker_col).alias("ticker"))
        .agg(F.min_by(value_col, at).alias("open"), F.max(value_col).alias("high"), F.min(value_col).alias("low"), F.max_by(value_col, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    )
    return out.select(F.to_date("_w.start").alias("date"), "ticker", "open", "high", "low", "close", "volume")
