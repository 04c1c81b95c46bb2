"""Smoothing, dispersion, moments, normalisation, ranks and bins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, TICKER, Window, by_ticker, frame, gated, quantile, safe_div, windowed
from panelkiln.operators.base import dispatch


def smooth(df: DataFrame, input_cols: str | list[str] = "close", output_cols: list[str] | None = None, window_type: str = "rolling", window_size: int = 30, central_tendency: str = "mean", lags: int = 0, min_periods: int | None = None) -> DataFrame:
    """Windowed mean or median along each ticker, then lagged. Without min_periods: the whole window if rolling, else one value."""
    cols = [input_cols] if isinstance(input_cols, str) else input_cols
    least = min_periods if min_periods is not None else window_size if window_type == "rolling" else 1
    for c, o in zip(cols, output_cols or [f"{c}_smooth" for c in cols], strict=True):
        df = windowed(df, c, o, central_tendency, "ts", window_type, window_size, least)
        if lags:
            df = df.withColumn(o, F.lag(o, lags).over(by_ticker()))
    return df


def _one(how: str, output: str, window_type: str, least: int):
    def op(df: DataFrame, input_col: str = "ret", output_col: str = output, axis: str = "ts", window_type: str = window_type, window_size: int = 30, min_periods: int = least) -> DataFrame:
        return windowed(df, input_col, output_col, how, axis, window_type, window_size, min_periods)

    op.__name__ = how
    return op


std, variance = _one("std", "std", "rolling", 2), _one("var", "var", "expanding", 1)
iqr, min_max = _one("iqr", "iqr", "expanding", 1), _one("range", "range", "expanding", 1)
skewness, kurtosis = _one("skew", "skew", "rolling", 2), _one("kurt", "kurt", "rolling", 2)


def windowed_quantile(df: DataFrame, input_col: str = "ret", output_col: str = "quantile", q: float = 0.5, axis: str = "ts", window_type: str = "expanding", window_size: int = 30, min_periods: int = 1) -> DataFrame:
    x, w = F.col(input_col), frame(axis, window_type, window_size)
    return df.withColumn(output_col, gated(x, quantile(x, q).over(w), w, min_periods))


def mad(df: DataFrame, input_col: str = "ret", output_col: str = "mad", axis: str = "ts", window_type: str = "rolling", window_size: int = 30, min_periods: int = 1) -> DataFrame:
    """Median over the window of |x - the windowed median at each row|, over 0.6745."""
    x, w = F.col(input_col), frame(axis, window_type, window_size)
    off = df.withColumn("_off", F.abs(x - gated(x, quantile(x, 0.5).over(w), w, min_periods)))
    o = F.col("_off")
    return off.withColumn(output_col, gated(o, quantile(o, 0.5).over(w) / 0.6745, w, min_periods)).drop("_off")


def true_range(high_col: str = "high", low_col: str = "low", close_col: str = "close") -> Column:
    last = F.lag(close_col).over(by_ticker())
    return F.greatest(F.col(high_col) - F.col(low_col), F.abs(F.col(high_col) - last), F.abs(F.col(low_col) - last))


def atr(df: DataFrame, high_col: str = "high", low_col: str = "low", close_col: str = "close", output_col: str = "atr", window_type: str = "expanding", window_size: int = 30, min_periods: int = 1) -> DataFrame:
    """Mean of the true range. The last close is that of the ticker's row before: densify a panel with gaps first."""
    df = df.withColumn("_tr", true_range(high_col, low_col, close_col))
    return windowed(df, "_tr", output_col, "mean", "ts", window_type, window_size, min_periods).drop("_tr")


dispersion = dispatch("dispersion", {"std": std, "variance": variance, "iqr": iqr, "mad": mad, "min_max": min_max, "quantile": windowed_quantile, "atr": atr})


def center(df: DataFrame, input_col: str = "close", output_col: str = "center", method: str = "mean", axis: str = "ts", window_type: str = "expanding", window_size: int = 30, min_periods: int = 1) -> DataFrame:
    df = windowed(df, input_col, "_mid", method, axis, window_type, window_size, min_periods)
    return df.withColumn(output_col, F.col(input_col) - F.col("_mid")).drop("_mid")


def _clipped(x: Column, limit: float | None) -> Column:
    return x if limit is None else F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(limit))), F.lit(-float(limit))))


def _scored(middle: str, spread) -> object:
    def op(df: DataFrame, input_col: str = "close", output_col: str = "zscore", axis: str = "ts", centering: bool = True, window_type: str = "expanding", window_size: int = 30, min_periods: int = 2, winsorize: float | None = None) -> DataFrame:
        top = F.col(input_col)
        if centering:
            df = windowed(df, input_col, "_mid", middle, axis, window_type, window_size, min_periods)
            top = top - F.col("_mid")
        df = spread(df, input_col=input_col, output_col="_spread", axis=axis, window_type=window_type, window_size=window_size, min_periods=min_periods)
        return df.withColumn(output_col, _clipped(safe_div(top, F.col("_spread")), winsorize)).drop("_mid", "_spread")

    return op


zscore, robust_zscore, mod_zscore = _scored("mean", std), _scored("median", iqr), _scored("median", mad)


def min_max_scaler(df: DataFrame, input_col: str = "close", output_col: str = "min_max_scaled", axis: str = "ts", centering: bool = True, window_type: str = "expanding", window_size: int = 30, min_periods: int = 1) -> DataFrame:
    x, w = F.col(input_col), frame(axis, window_type, window_size)
    low, high = F.min(x).over(w), F.max(x).over(w)
    value = safe_div(x - low if centering else x, high - low)
    return df.withColumn(output_col, gated(x, F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))), w, min_periods))


def atr_scaler(df: DataFrame, input_col: str = "close", output_col: str = "atr_scaled", centering: bool = True, window_type: str = "expanding", window_size: int = 30, min_periods: int = 1) -> DataFrame:
    """(difference - its windowed median) / average true range."""
    df = df.withColumn("_d", F.col(input_col) - F.lag(input_col).over(by_ticker()))
    df = atr(df, output_col="_atr", window_type=window_type, window_size=window_size, min_periods=min_periods)
    top = F.col("_d")
    if centering:
        df = windowed(df, "_d", "_mid", "median", "ts", "expanding" if window_type == "ewm" else window_type, window_size, min_periods)
        top = top - F.col("_mid")
    return df.withColumn(output_col, safe_div(top, F.col("_atr"))).drop("_d", "_mid", "_atr")


def rank(df: DataFrame, input_col: str = "close", output_col: str = "rank", axis: str = "ts", percentile: bool = False, window_type: str = "expanding", window_size: int = 30, min_periods: int = 2) -> DataFrame:
    """Rank with ties at their mean, over the number of values if `percentile`. NULL has no rank and isn't counted.

    Whole partitions rank by sorting; moving frames count the smaller and equal values of the frame.
    """
    x = F.col(input_col)
    w = frame(axis, window_type, window_size)
    n = F.count(x).over(w)
    if axis == "cs" or window_type == "fixed":
        key = DATE if axis == "cs" else TICKER
        place = F.rank().over(Window.partitionBy(key).orderBy(x.asc_nulls_last())) + (F.count(x).over(Window.partitionBy(key, x)) - 1) / 2
    else:
        df = df.withColumn("_seen", F.collect_list(x).over(w))
        place = F.expr(f"size(filter(_seen, v -> v < {input_col})) + (size(filter(_seen, v -> v = {input_col})) + 1) / 2")
    place = F.when(x.isNotNull() & (n >= min_periods), place / n if percentile else place.cast("double"))
    return df.withColumn(output_col, place).drop("_seen")


def percentile(df: DataFrame, input_col: str = "close", output_col: str = "percentile", **window) -> DataFrame:
    return rank(df, input_col, output_col, percentile=True, **{"min_periods": 1, **window})


def quantize(df: DataFrame, input_col: str = "zscore", output_col: str = "quantile", bins: int = 5, **window) -> DataFrame:
    """1 to bins, by percentile rank."""
    df = rank(df, input_col, "_pct", percentile=True, **window)
    return df.withColumn(output_col, F.ceil(F.round(F.col("_pct") * float(bins), 9)).cast("double")).drop("_pct")


def discretize(df: DataFrame, input_col: str = "zscore", output_col: str = "discretized", bins: int = 5, axis: str = "ts", method: str = "quantile", window_type: str = "expanding", window_size: int = 30, min_periods: int = 1) -> DataFrame:
    """1 to bins, by edges at quantiles or at equal distances of the frame, or by k-means centres of a date or ticker."""
    x = F.col(input_col)
    if method == "kmeans":
        return _kmeans_bins(df, input_col, output_col, bins, DATE if axis == "cs" else TICKER)
    w = frame(axis, window_type, window_size)
    if method == "uniform":
        low, high = F.min(x).over(w), F.max(x).over(w)
        place = F.least(F.floor(safe_div((x - low) * bins, high - low)), F.lit(bins - 1)) + 1
        place = F.coalesce(place, F.when(x.isNotNull(), 1))
    else:
        place = F.lit(1)
        for k in range(1, bins):
            place = place + F.when(x >= quantile(x, k / bins).over(w), 1).otherwise(0)
    return df.withColumn(output_col, F.when(x.isNotNull(), gated(x, place, w, min_periods)).cast("double"))


def _kmeans_bins(df: DataFrame, input_col: str, output_col: str, bins: int, key: str) -> DataFrame:
    schema = df.drop(output_col).schema.add(output_col, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[input_col].astype("float64").to_numpy()
        ok = np.isfinite(x)
        out = np.full(len(x), np.nan)
        if ok.any():
            v = x[ok]
            c = np.quantile(v, (np.arange(min(bins, len(np.unique(v)))) + 0.5) / min(bins, len(np.unique(v))))
            for _ in range(100):
                at = np.abs(v[:, None] - c).argmin(1)
                new = np.array([v[at == k].mean() if (at == k).any() else c[k] for k in range(len(c))])
                if np.allclose(new, c):
                    break
                c = new
            out[ok] = np.searchsorted((np.sort(c)[1:] + np.sort(c)[:-1]) / 2, v, side="right") + 1
        return pdf.assign(**{output_col: out})[[f.name for f in schema]]

    return df.groupBy(key).applyInPandas(run, schema)


def _best_lambda(x: np.ndarray, transform) -> float:
    """The exponent of largest likelihood, by golden section between -4 and 4."""
    logs = transform.slope(x)

    def loss(lam: float) -> float:
        v = transform.apply(x, lam).var()
        return 0.5 * len(x) * np.log(v) - (lam - 1) * logs if v > 0 else np.inf

    a, b, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return (a + b) / 2


class BoxCox:
    @staticmethod
    def slope(x):
        return np.log(x).sum()

    @staticmethod
    def apply(x, lam):
        return np.log(x) if abs(lam) < 1e-9 else (x**lam - 1) / lam


class YeoJohnson:
    @staticmethod
    def slope(x):
        return (np.sign(x) * np.log1p(np.abs(x))).sum()

    @staticmethod
    def apply(x, lam):
        up, out = x >= 0, np.empty_like(x)
        out[up] = np.log1p(x[up]) if abs(lam) < 1e-9 else ((x[up] + 1) ** lam - 1) / lam
        out[~up] = -np.log1p(-x[~up]) if abs(lam - 2) < 1e-9 else -((1 - x[~up]) ** (2 - lam) - 1) / (2 - lam)
        return out


def power_last(x: np.ndarray, method: str, adjustment: float = 1e-6) -> np.ndarray:
    """A sample made as normal as a power can make it, then standardised."""
    x = np.asarray(x, float)
    kind = BoxCox if method == "box-cox" else YeoJohnson
    if method == "box-cox":
        x = x - x.min() + adjustment
    y = kind.apply(x, _best_lambda(x, kind))
    s = y.std()
    return (y - y.mean()) / s if s > 0 else np.full(len(y), np.nan)


def power_transform(df: DataFrame, input_col: str = "zscore", output_col: str = "power_zscore", method: str = "box-cox", axis: str = "ts", window_type: str = "expanding", window_size: int = 30, min_periods: int = 2, adjustment: float = 1e-6) -> DataFrame:
    """Box-Cox or Yeo-Johnson with the likeliest exponent, fitted to each window anew (its last row stays), or to each date."""
    key = DATE if axis == "cs" else TICKER
    schema = df.drop(output_col).schema.add(output_col, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([DATE, TICKER], kind="stable")
        x = pdf[input_col].astype("float64").to_numpy()
        out = np.full(len(x), np.nan)
        whole = axis == "cs" or window_type == "fixed"
        for i in [len(x) - 1] if whole else range(len(x)):
            a = 0 if whole or window_type == "expanding" else max(0, i - window_size + 1)
            ok = np.flatnonzero(np.isfinite(x[a : i + 1])) + a
            if len(ok) >= max(2, min_periods):
                y = power_last(x[ok], method, adjustment)
                if whole:
                    out[ok] = y
                elif ok[-1] == i:
                    out[i] = y[-1]
        return pdf.assign(**{output_col: out})[[f.name for f in schema]]

    return df.groupBy(key).applyInPandas(run, schema)


normalize = dispatch(
    "normalize",
    {"zscore": zscore, "z-score": zscore, "robust_zscore": robust_zscore, "mod_zscore": mod_zscore, "percentile": percentile, "min_max": min_max_scaler, "atr_scaler": atr_scaler, "power_transform": power_transform},
)

