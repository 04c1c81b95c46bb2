"""Windows over a panel and the aggregates that run on them.

A panel has unique (date, ticker) rows; NULL is the only missing value. `axis` 'ts' looks along a ticker's dates, 'cs' across a
date's tickers. `window_type` for 'ts': 'rolling' (the last n rows), 'expanding', 'fixed' (all rows, which looks ahead), 'ewm' (kernel).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE, TICKER = "date", "ticker"


def by_ticker():
    return Window.partitionBy(TICKER).orderBy(DATE)


def frame(axis: str = "ts", window_type: str = "rolling", n: int = 30):
    if axis == "cs":
        return Window.partitionBy(DATE)
    if window_type == "rolling":
        return by_ticker().rowsBetween(-(n - 1), 0)
    if window_type == "expanding":
        return by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    if window_type == "fixed":
        return Window.partitionBy(TICKER)
    raise ValueError(f"no such window: {axis} {window_type}")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def gated(x: Column, value: Column, w, least: int) -> Column:
    """value where the frame has at least `least` non-null x."""
    return F.when(F.count(x).over(w) >= least, value)


def quantile(x: Column, q: float) -> Column:
    """Linear-interpolated quantile; takes ROWS frames."""
    return F.percentile(x, F.lit(q))


def g1(x: Column, w) -> Column:
    """Bias-adjusted skewness; NULL below 3 values or without spread."""
    n = F.count(x).over(w).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(x).over(w) > 0), F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / (n - 2))


def g2(x: Column, w) -> Column:
    """Bias-adjusted excess kurtosis; NULL below 4 values or without spread."""
    n = F.count(x).over(w).cast("double")
    return F.when((n >= 4) & (F.stddev_pop(x).over(w) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6))


AGGREGATES: dict[str, Callable] = {
    "mean": lambda x, w: F.avg(x).over(w),
    "sum": lambda x, w: F.sum(x).over(w),
    "min": lambda x, w: F.min(x).over(w),
    "max": lambda x, w: F.max(x).over(w),
    "median": lambda x, w: quantile(x, 0.5).over(w),
    "std": lambda x, w: F.stddev_samp(x).over(w),
    "var": lambda x, w: F.var_samp(x).over(w),
    "range": lambda x, w: F.max(x).over(w) - F.min(x).over(w),
    "iqr": lambda x, w: (quantile(x, 0.75).over(w) - quantile(x, 0.25).over(w)) / 1.349,
    "skew": g1,
    "kurt": g2,
}


def ewm(df: DataFrame, inputs: dict[str, str], span: float | None = None, how: str = "mean", halflife: float | None = None, least: int = 0) -> DataFrame:
    """Exponentially weighted mean, std or var along each ticker (adjusted weights, gaps decay). inputs: output name -> input column.

    A kernel over one ticker's rows, as no built-in frame has such weights; all columns asked for go through it at once.
    """
    names = list(inputs)
    out_schema = df.select(*[c for c in df.columns if c not in names]).schema
    for n in names:
        out_schema = out_schema.add(n, "double")
    order = [f.name for f in out_schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE, kind="stable")
        made = {o: getattr(pdf[c].astype("float64").ewm(span=span, halflife=halflife, min_periods=least), how)() for o, c in inputs.items()}
        return pdf.assign(**made)[order]

    return df.groupBy(TICKER).applyInPandas(run, out_schema)


def windowed(df: DataFrame, input_col: str, output_col: str, how: str, axis: str = "ts", window_type: str = "rolling", n: int = 30, least: int = 1) -> DataFrame:
    """df with one windowed aggregate added."""
    if axis == "ts" and window_type == "ewm":
        if how == "iqr" or how not in ("mean", "std", "var"):
            raise ValueError(f"no exponentially weighted {how}")
        return ewm(df, {output_col: input_col}, span=n, how=how, least=least)
    x, w = F.col(input_col).cast("double"), frame(axis, window_type, n)
    return df.withColumn(output_col, gated(x, AGGREGATES[how](x, w), w, least))
