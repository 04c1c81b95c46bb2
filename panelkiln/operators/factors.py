"""Factors: trend, volatility, carry, value, size, low risk, reversal, liquidity and skew.

Each adds a column named {Name}_{window} or as given. Templates scale, smooth, clip and flip signs by the same parameters everywhere.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import AGGREGATES, DATE, TICKER, by_ticker, clean, ewm, frame, g1, safe_div, windowed
from panelkiln.operators import regress, scalars, windows
from panelkiln.operators.base import dispatch


def finish(df: DataFrame, column: str, scale: str | None = None, scaling_col: str = "ret", scaling_window: int = 365, smooth: int | None = None, winsorize: float | None = None, sign_flip: bool = False, times: float = 1.0) -> DataFrame:
    """What all factors may do to their column: divide by a rolling dispersion, smooth by an EWM, clip, flip, multiply."""
    if scale:
        df = windows.dispersion(df, scale, input_col=scaling_col, output_col="_scale", window_type="rolling", window_size=scaling_window)
        df = df.withColumn(column, safe_div(F.col(column), F.col("_scale"))).drop("_scale")
    if smooth:
        df = ewm(df.withColumnRenamed(column, "_raw"), {column: "_raw"}, span=smooth).drop("_raw")
    x = F.col(column) * (-times if sign_flip else times)
    if winsorize is not None:
        x = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(winsorize))), F.lit(-float(winsorize))))
    return df.withColumn(column, x)


def _moved(df: DataFrame, c: str, out: str, how: str, window_type: str, n: int, least: int | None = None) -> DataFrame:
    return windowed(df, c, out, how, "ts", window_type, n, least if least is not None else (n if window_type == "rolling" else 1))


# Trend


def price_momentum(df: DataFrame, input_col: str = "close", window_size: int = 30, **rest) -> DataFrame:
    out = f"PriceMomentum_{window_size}"
    c = F.when(F.col(input_col) > 0, F.log(input_col))
    return finish(df.withColumn(out, (c - F.lag(c, window_size).over(by_ticker())) / math.sqrt(window_size)), out, **rest)


def ewma(df: DataFrame, input_col: str = "close", window_type: str = "ewm", window_size: int = 30, **rest) -> DataFrame:
    out = f"EWMA_{window_size}"
    df = scalars.log_return(df, input_col, "_r")
    return finish(_moved(df, "_r", out, "mean", window_type, window_size).drop("_r"), out, **rest)


def divergence(df: DataFrame, input_col: str = "close", window_type: str = "ewm", window_size: int = 30, **rest) -> DataFrame:
    out = f"Divergence_{window_size}"
    df = df.withColumn("_s", F.signum(F.col(input_col) - F.lag(input_col).over(by_ticker())))
    return finish(_moved(df, "_s", out, "mean", window_type, window_size).drop("_s"), out, **rest)


def time_trend(df: DataFrame, input_col: str = "close", window_type: str = "rolling", window_size: int = 30, **rest) -> DataFrame:
    out = f"TimeTrend_{window_size}"
    return finish(regress.betas(regress.time_index(df), input_col, "_time", out, window_type, window_size).drop("_time"), out, **rest)


def price_acceleration(df: DataFrame, input_col: str = "close", window_type: str = "rolling", window_size: int = 30, **rest) -> DataFrame:
    """The coefficient of squared time in a quadratic fit."""
    out = f"PriceAcceleration_{window_size}"
    df = regress.time_index(df).withColumn("_time2", F.col("_time") * F.col("_time"))
    df = regress.rolling_multi_ols(df, input_col, ["_time", "_time2"], "_fit", window_type, window_size).withColumn(out, F.col("_fit__time2"))
    return finish(df.drop("_time", "_time2", "_fit_const", "_fit__time", "_fit__time2", "_fit_resid", "_fit_r2"), out, **rest)


def alpha_momentum(df: DataFrame, return_col: str = "ret", factor_col: str = "market", window_type: str = "rolling", window_size: int = 30, **rest) -> DataFrame:
    out = f"AlphaMomentum_{window_size}"
    return finish(regress.intercepts(df, return_col, factor_col, out, window_type, window_size), out, **rest)


def idiosyncratic_ewma(df: DataFrame, return_col: str = "ret", factor_col: str = "market", window_size: int = 30, **rest) -> DataFrame:
    out = f"IdiosyncraticEWMA_{window_size}"
    df = regress.idiosyncratic_returns(df, return_col, factor_col, "_i", window_size=window_size)
    return finish(ewm(df, {out: "_i"}, span=window_size).drop("_i"), out, **rest)


def rsi(df: DataFrame, input_col: str = "close", window_type: str = "rolling", window_size: int = 30, central_tendency: str = "mean", signal: bool = True, output_col: str | None = None, **rest) -> DataFrame:
    out = output_col or f"RSI_{window_size}"
    df = scalars.log_return(df, input_col, "_r")
    df = df.withColumns({"_up": F.when(F.col("_r").isNotNull(), F.greatest("_r", F.lit(0.0))), "_down": F.when(F.col("_r").isNotNull(), F.greatest(-F.col("_r"), F.lit(0.0)))})
    if window_type == "ewm":
        df = ewm(df, {"_u": "_up", "_d": "_down"}, span=window_size)
    else:
        df = _moved(_moved(df, "_up", "_u", central_tendency, window_type, window_size), "_down", "_d", central_tendency, window_type, window_size)
    value = 100 - 100 / (1 + safe_div(F.col("_u"), F.col("_d")))
    value = F.coalesce(value, F.when(F.col("_u") > 0, 100.0))
    return finish(df.withColumn(out, (value - 50) / 50 if signal else value).drop("_r", "_up", "_down", "_u", "_d"), out, **rest)


def stochastic(df: DataFrame, high_col: str = "high", low_col: str = "low", close_col: str = "close", kind: str = "d", short_window_size: int | None = None, window_size: int = 30, signal: bool = True, **rest) -> DataFrame:
    out, w = f"Stochastic_{window_size}", frame("ts", "rolling", window_size)
    low, high = F.min(low_col).over(w), F.max(high_col).over(w)
    k = safe_div(F.col(close_col) - low, high - low)
    df = df.withColumn("_k", F.when(k.isNotNull(), F.greatest(F.least(k, F.lit(1.0)), F.lit(0.0))))
    short = short_window_size or math.ceil(math.sqrt(window_size))
    df = _moved(df, "_k", "_v", "mean", "rolling", short) if kind == "d" else df.withColumn("_v", F.col("_k"))
    return finish(df.withColumn(out, F.col("_v") * 2 - 1 if signal else F.col("_v")).drop("_k", "_v"), out, **rest)


def intensity(df: DataFrame, open_col: str = "open", high_col: str = "high", low_col: str = "low", close_col: str = "close", window_size: int = 30, smooth: int | None = None, **rest) -> DataFrame:
    out = f"Intensity_{window_size}"
    value = safe_div(F.col(close_col) - F.col(open_col), windows.true_range(high_col, low_col, close_col))
    return finish(df.withColumn(out, value), out, smooth=smooth if smooth is not None else window_size, **rest)


def mw_difference(df: DataFrame, input_col: str = "close", window_type: str = "rolling", short_window_size: int | None = None, window_size: int = 30, central_tendency: str = "mean", **rest) -> DataFrame:
    out, short = f"MWDifference_{window_size}", short_window_size or math.ceil(math.sqrt(window_size))
    df = _moved(_moved(df, input_col, "_s", central_tendency, window_type, short), input_col, "_l", central_tendency, window_type, window_size)
    return finish(df.withColumn(out, F.col("_s") - F.col("_l")).drop("_s", "_l"), out, **rest)


#: Half-life pairs of the triple difference.
HALF_LIVES = ((8, 24), (16, 48), (32, 96))


def triple_ewma_difference(df: DataFrame, input_col: str = "close", signal: bool = True, price_window: int = 90, own_window: int = 365, **rest) -> DataFrame:
    """Mean over three pairs of EWM differences, each over the price's rolling std and then its own, pressed by z exp(-z^2 / 4) / 0.89."""
    out = "TripleEWMADifference"
    life = lambda n: math.log(0.5) / math.log(1 - 1 / n)
    df = _moved(df, input_col, "_sd", "std", "rolling", price_window, 2)
    parts = []
    for k, (a, b) in enumerate(HALF_LIVES):
        df = ewm(ewm(df, {f"_a{k}": input_col}, halflife=life(a)), {f"_b{k}": input_col}, halflife=life(b))
        df = df.withColumn(f"_y{k}", safe_div(F.col(f"_a{k}") - F.col(f"_b{k}"), F.col("_sd")))
        df = _moved(df, f"_y{k}", f"_s{k}", "std", "rolling", own_window, 2)
        z = safe_div(F.col(f"_y{k}"), F.col(f"_s{k}"))
        parts.append(z * F.exp(-z * z / 4) / 0.89 if signal else z)
    n = sum(F.when(p.isNotNull(), 1).otherwise(0) for p in parts)
    df = df.withColumn("_m", sum(F.coalesce(p, F.lit(0.0)) for p in parts) / F.nullif(n.cast("double"), F.lit(0.0)))
    df = df.withColumn(out, F.last("_m", ignorenulls=True).over(frame("ts", "expanding")))
    return finish(df.drop("_sd", "_m", *[f"_{c}{k}" for c in "abys" for k in range(3)]), out, **rest)


def energy(df: DataFrame, input_col: str = "close", window_size: int = 30, mass_method: str = "std", perc: float = 0.05, **rest) -> DataFrame:
    """Return over the window times its mass: its std, or the tail quantile on the return's side."""
    out, w = f"Energy_{window_size}", frame("ts", "rolling", window_size)
    df = scalars.log_return(scalars.log_return(df, input_col, "_r"), input_col, "_n", window_size)
    r, n = F.col("_r"), F.col("_n")
    if mass_method == "std":
        mass = F.stddev_samp(r).over(w)
    else:
        mass = F.when(n >= 0, F.abs(F.percentile(r, F.lit(1 - perc)).over(w))).otherwise(F.abs(F.percentile(r, F.lit(perc)).over(w)))
    return finish(df.withColumn(out, n * mass).drop("_r", "_n"), out, **rest)


def snr(df: DataFrame, input_col: str = "close", window_size: int = 30, **rest) -> DataFrame:
    out, w = f"SNR_{window_size}", frame("ts", "rolling", window_size)
    df = df.withColumn("_d", F.abs(F.col(input_col) - F.lag(input_col).over(by_ticker())))
    path = F.when(F.count("_d").over(w) >= window_size, F.sum("_d").over(w))
    return finish(df.withColumn(out, safe_div(F.col(input_col) - F.lag(input_col, window_size).over(by_ticker()), path)).drop("_d"), out, **rest)


def adx(df: DataFrame, high_col: str = "high", low_col: str = "low", close_col: str = "close", window_type: str = "rolling", window_size: int = 30, signal: bool = True, **rest) -> DataFrame:
    """Directional movement; in signal mode the signed index over 100, clipped to 1."""
    out = f"ADX_{window_size}"
    up = F.col(high_col) - F.lag(high_col).over(by_ticker())
    down = F.lag(low_col).over(by_ticker()) - F.col(low_col)
    df = df.withColumns({"_p": F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0), "_m": F.when((down > up) & (down > 0), down).when(down.isNotNull(), 0.0), "_t": windows.true_range(high_col, low_col, close_col)})
    if window_type == "ewm":
        df = ewm(df, {"_pp": "_p", "_mm": "_m", "_tt": "_t"}, span=window_size)
    else:
        for c in "pmt":
            df = _moved(df, f"_{c}", f"_{c}{c}", "mean", window_type, window_size)
    p, m = safe_div(F.col("_pp"), F.col("_tt")), safe_div(F.col("_mm"), F.col("_tt"))
    df = df.withColumn("_dx", safe_div(p - m if signal else F.abs(p - m), p + m))
    df = _moved(df, "_dx", "_x", "mean", window_type, window_size)
    value = F.when(F.col("_x").isNotNull(), F.greatest(F.least("_x", F.lit(1.0)), F.lit(-1.0))) if signal else F.col("_x") * 100
    return finish(df.withColumn(out, value).drop("_p", "_m", "_t", "_pp", "_mm", "_tt", "_dx", "_x"), out, **rest)


def breakout(df: DataFrame, input_col: str = "close", method: str = "min_max", window_type: str = "rolling", window_size: int = 30, signal: bool = True, **rest) -> DataFrame:
    out = f"Breakout_{window_size}"
    df = windows.normalize(df, method, input_col=input_col, output_col=out, window_type=window_type, window_size=window_size, min_periods=window_size)
    return finish(df.withColumn(out, F.col(out) * 2 - 1) if signal else df, out, **rest)


trend = dispatch(
    "trend",
    {"breakout": breakout, "price_momentum": price_momentum, "price_mom": price_momentum, "ewma": ewma, "divergence": divergence, "time_trend": time_trend, "price_acc": price_acceleration, "alpha_mom": alpha_momentum, "idio_ewma": idiosyncratic_ewma,
     "rsi": rsi, "stochastic": stochastic, "intensity": intensity, "mw_diff": mw_difference, "triple_ewma_diff": triple_ewma_difference, "energy": energy, "snr": snr, "adx": adx},
)

# Volatility


def _vol(name: str, how: str):
    def op(df: DataFrame, input_col: str = "ret", window_type: str = "rolling", window_size: int = 30, annualize: bool = True, ann_factor: int = 365, sign_flip: bool = False) -> DataFrame:
        out = f"{name}_{window_size}"
        method = {"std": windows.std, "iqr": windows.iqr, "mad": windows.mad}[how]
        df = method(df, input_col=input_col, output_col=out, window_type=window_type, window_size=window_size)
        return finish(df, out, sign_flip=sign_flip, times=math.sqrt(ann_factor) if annualize else 1.0)

    op.__name__ = how
    return op


vol_std, vol_iqr, vol_mad = _vol("STD", "std"), _vol("IQR", "iqr"), _vol("MAD", "mad")


def vol_atr(df: DataFrame, window_type: str = "rolling", window_size: int = 30, annualize: bool = True, ann_factor: int = 365, sign_flip: bool = False) -> DataFrame:
    out = f"ATR_{window_size}"
    return finish(windows.atr(df, output_col=out, window_type=window_type, window_size=window_size), out, sign_flip=sign_flip, times=math.sqrt(ann_factor) if annualize else 1.0)


def _mean_of(df: DataFrame, parts: dict, window_type: str, n: int) -> DataFrame:
    df = df.withColumns(parts)
    if window_type == "ewm":
        return ewm(df, {f"{c}m": c for c in parts}, span=n)
    for c in parts:
        df = _moved(df, c, f"{c}m", "mean", window_type, n, 1)
    return df


def _ln(a: str, b: str):
    return clean(F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(F.col(a) / F.col(b))))


def garman_klass(df: DataFrame, window_type: str = "rolling", window_size: int = 30, annualize: bool = True, ann_factor: int = 365, sign_flip: bool = False) -> DataFrame:
    out = f"GarmanKlass_{window_size}"
    df = _mean_of(df, {"_hl": _ln("high", "low") * _ln("high", "low"), "_co": _ln("close", "open") * _ln("close", "open")}, window_type, window_size)
    v = F.col("_hlm") / 2 - (2 * math.log(2) - 1) * F.col("_com")
    return finish(df.withColumn(out, F.when(v >= 0, F.sqrt(v))).drop("_hl", "_co", "_hlm", "_com"), out, sign_flip=sign_flip, times=math.sqrt(ann_factor) if annualize else 1.0)


def parkinson(df: DataFrame, window_type: str = "rolling", window_size: int = 30, annualize: bool = True, ann_factor: int = 365, sign_flip: bool = False, constant_inside: bool = False) -> DataFrame:
    """The constant 1 / (4 ln 2) stands outside the root, or inside as published."""
    out = f"Parkinson_{window_size}"
    df = _mean_of(df, {"_hl": _ln("high", "low") * _ln("high", "low")}, window_type, window_size)
    k = 1 / (4 * math.log(2))
    return finish(df.withColumn(out, F.sqrt(F.col("_hlm")) * (math.sqrt(k) if constant_inside else k)).drop("_hl", "_hlm"), out, sign_flip=sign_flip, times=math.sqrt(ann_factor) if annualize else 1.0)


def rogers_satchell(df: DataFrame, window_type: str = "rolling", window_size: int = 30, annualize: bool = True, ann_factor: int = 365, sign_flip: bool = False) -> DataFrame:
    out = f"RogersSatchell_{window_size}"
    df = _mean_of(df, {"_rs": _ln("high", "close") * _ln("high", "open") + _ln("low", "close") * _ln("low", "open")}, window_type, window_size)
    return finish(df.withColumn(out, F.when(F.col("_rsm") >= 0, F.sqrt("_rsm"))).drop("_rs", "_rsm"), out, sign_flip=sign_flip, times=math.sqrt(ann_factor) if annualize else 1.0)


def ivol(df: DataFrame, return_col: str = "ret", factor_col: str = "market", window_size: int = 30, annualize: bool = True, ann_factor: int = 365, sign_flip: bool = False) -> DataFrame:
    out = f"IVol_{window_size}"
    df = regress.idiosyncratic_returns(df, return_col, factor_col, "_i", window_size=window_size)
    return finish(_moved(df, "_i", out, "std", "rolling", window_size, 2).drop("_i"), out, sign_flip=sign_flip, times=math.sqrt(ann_factor) if annualize else 1.0)


vol = dispatch("vol", {"std": vol_std, "iqr": vol_iqr, "mad": vol_mad, "atr": vol_atr, "garman_klass": garman_klass, "parkinson": parkinson, "rogers_satchell": rogers_satchell, "ivol": ivol})

# Carry, value, size, low risk, reversal


def carry(df: DataFrame, spot_col: str = "spot", rate_col: str | None = None, fwd_col: str | None = None, annualize: bool = True, ann_factor: int = 365, sign_flip: bool = True, scale: bool = False, scaling_window: int = 365, output_col: str = "carry") -> DataFrame:
    """The rate, or forward over spot less one; rows with a spot or forward of 0 are dropped. Scaled by the rolling std of the spot's log returns where asked for."""
    df = df.filter(F.col(spot_col) != 0)
    if fwd_col:
        df = df.filter(F.col(fwd_col) != 0)
    df = df.withColumn(output_col, F.col(fwd_col) / F.col(spot_col) - 1 if fwd_col else F.col(rate_col))
    if scale:
        df = scalars.log_return(df, spot_col, "_r")
        df = _moved(df, "_r", "_sd", "std", "rolling", scaling_window, 2)
        df = df.withColumn(output_col, safe_div(F.col(output_col), F.col("_sd"))).drop("_r", "_sd")
    return finish(df, output_col, sign_flip=sign_flip, times=math.sqrt(ann_factor) if annualize else 1.0)


def carry_vol(df: DataFrame, **params) -> DataFrame:
    return carry(df, **{"scale": True, "output_col": "carry_vol", **params})


VALUE_FUNCTIONS = {"metcalfe": lambda x: x * x, "zipf": lambda x: F.when(x > 0, x * F.log(x)), "metcalfe_gen": lambda x: F.when(x >= 0, F.pow(x, F.lit(1.5))), "metcalfe_sqrt": lambda x: F.sqrt(x * x)}


def _fundamental(c: str, function: str | None):
    return VALUE_FUNCTIONS[function](F.col(c)) if function else F.col(c)


def value_ratio(df: DataFrame, fundamental_col: str, price_col: str, value_function: str | None = None, sign_flip: bool = True, output_col: str = "value_ratio") -> DataFrame:
    return finish(df.withColumn(output_col, safe_div(_fundamental(fundamental_col, value_function), F.col(price_col))), output_col, sign_flip=sign_flip)


def value_residual(df: DataFrame, fundamental_col: str, price_col: str, value_function: str | None = None, window_type: str = "rolling", window_size: int = 360, sign_flip: bool = True, output_col: str = "value_residual") -> DataFrame:
    df = df.withColumn("_f", _fundamental(fundamental_col, value_function))
    return finish(regress.residuals(df, price_col, "_f", output_col, window_type, window_size).drop("_f"), output_col, sign_flip=sign_flip)


def size(df: DataFrame, size_col: str, sign_flip: bool = True, output_col: str = "size") -> DataFrame:
    return finish(df.withColumn(output_col, F.col(size_col)), output_col, sign_flip=sign_flip)


def low_beta(df: DataFrame, return_col: str = "ret", factor_col: str = "market", window_size: int = 30, sign_flip: bool = True) -> DataFrame:
    out = f"Beta_{window_size}"
    return finish(regress.betas(df, return_col, factor_col, out, "rolling", window_size), out, sign_flip=sign_flip)


def max_dd(df: DataFrame, return_col: str = "ret", ret_type: str = "simple", window_type: str = "rolling", window_size: int = 30, sign_flip: bool = False) -> DataFrame:
    """The least, over the window, of value over its windowed peak less one."""
    out, w = f"MaxDD_{window_size}", frame("ts", window_type, window_size)
    growth = F.log1p(F.col(return_col)) if ret_type == "simple" else F.col(return_col)
    df = df.withColumn("_v", F.when(F.col(return_col).isNotNull(), F.exp(F.sum(growth).over(frame("ts", "expanding")))))
    df = df.withColumn("_d", F.col("_v") / F.max("_v").over(w) - 1)
    return finish(df.withColumn(out, F.min("_d").over(w)).drop("_v", "_d"), out, sign_flip=sign_flip)


def mw_deviation(df: DataFrame, input_col: str = "close", central_tendency: str = "mean", window_type: str = "rolling", window_size: int = 30, sign_flip: bool = True, winsorize: float | None = None) -> DataFrame:
    out = f"MWDeviation_{window_size}"
    df = _moved(df, input_col, "_m", central_tendency, window_type, window_size)
    return finish(df.withColumn(out, F.col(input_col) - F.col("_m")).drop("_m"), out, sign_flip=sign_flip, winsorize=winsorize)


def linear_deviation(df: DataFrame, input_col: str = "close", window_type: str = "rolling", window_size: int = 30, sign_flip: bool = True, winsorize: float | None = None) -> DataFrame:
    out = f"LinearDeviation_{window_size}"
    return finish(regress.residuals(regress.time_index(df), input_col, "_time", out, window_type, window_size).drop("_time"), out, sign_flip=sign_flip, winsorize=winsorize)


def idiosyncratic_deviation(df: DataFrame, return_col: str = "ret", factor_col: str = "market", window_size: int = 30, sign_flip: bool = True) -> DataFrame:
    """Residual of the ticker's cumulated returns on the factor's; both are cumulated along each ticker."""
    out, w = f"IdiosyncraticDeviation_{window_size}", frame("ts", "expanding")
    df = df.withColumns({"_y": F.when(F.col(return_col).isNotNull(), F.sum(return_col).over(w)), "_x": F.when(F.col(factor_col).isNotNull(), F.sum(factor_col).over(w))})
    df = df.withColumnsRenamed({"_y": "_cum_y", "_x": "_cum_x"})
    return finish(regress.residuals(df, "_cum_y", "_cum_x", out, "rolling", window_size).drop("_cum_y", "_cum_x"), out, sign_flip=sign_flip)


def rsi_detrended(df: DataFrame, input_col: str = "close", short_window: int = 7, long_window: int = 30, window_size: int = 30, sign_flip: bool = True) -> DataFrame:
    out = f"RSIDetrended_{window_size}"
    df = rsi(rsi(df, input_col, window_size=short_window, output_col="_s"), input_col, window_size=long_window, output_col="_l")
    return finish(regress.residuals(df, "_s", "_l", out, "rolling", window_size).drop("_s", "_l"), out, sign_flip=sign_flip)


low_risk = dispatch("low_risk", {"beta": low_beta, "max_dd": max_dd})
reversal = dispatch("reversal", {"mw_deviation": mw_deviation, "linear_deviation": linear_deviation, "idio_deviation": idiosyncratic_deviation, "rsi_detrended": rsi_detrended})
value = dispatch("value", {"value_ratio": value_ratio, "value_residual": value_residual})
carries = dispatch("carry", {"carry": carry, "carry_vol": carry_vol})

# Liquidity and skew


def amihud(df: DataFrame, return_col: str = "ret", price_col: str = "close", volume_col: str = "volume", output_col: str = "amihud", scale: bool = False, smooth: int | None = None) -> DataFrame:
    df = df.withColumn(output_col, safe_div(F.abs(F.col(return_col)), F.col(price_col) * F.col(volume_col)) * (1e6 if scale else 1.0))
    return finish(df, output_col, smooth=smooth)


def traded_value(df: DataFrame, price_col: str = "close", volume_col: str = "volume", output_col: str = "notional_value", smooth: int | None = None) -> DataFrame:
    return finish(df.withColumn(output_col, F.nullif(F.col(price_col) * F.col(volume_col), F.lit(0.0))), output_col, smooth=smooth)


def high_low_spread(df: DataFrame, high_col: str = "high", low_col: str = "low", close_col: str = "close", output_col: str = "hl_spread", smooth: int | None = None, move_range: bool = False) -> DataFrame:
    """Corwin and Schultz's spread from two days' highs and lows; no less than 0.

    Each day's range is moved by its overnight gap, so it needs a close before it. The two days' joint range is as quoted; with move_range
    it is of the day as moved and of the day before as quoted, as is then that day's own range.
    """
    w = by_ticker()
    high, low, before = F.col(high_col), F.col(low_col), F.lag(close_col).over(w)
    gap = F.when(before < low, low - before).when(before > high, high - before).when(before.isNotNull(), F.lit(0.0))
    top, bottom, own, first = _free(df, "_top", "_bottom", "_own", "_alpha")
    square = lambda up, down: F.pow(F.log(up / F.nullif(down, F.lit(0.0))), F.lit(2.0))
    df = df.withColumns({top: high - gap, bottom: low - gap}).withColumn(own, square(F.col(top), F.col(bottom)))
    if move_range:
        high, low, past = F.col(top), F.col(bottom), square(F.lag(high_col).over(w), F.lag(low_col).over(w))
    else:
        past = F.lag(own).over(w)
    last_high, last_low = F.lag(high_col).over(w), F.lag(low_col).over(w)
    days = F.col(own) + past
    joint = F.when(last_high.isNotNull() & last_low.isNotNull(), square(F.greatest(high, last_high), F.least(low, last_low)))
    k = 3 - 2 * math.sqrt(2)
    df = df.withColumn(first, clean((math.sqrt(2) - 1) * F.sqrt(days) / k - F.sqrt(joint / k)))
    spread = F.when(F.col(first).isNotNull(), 2 * F.tanh(F.greatest(F.col(first), F.lit(0.0)) / 2))
    return finish(df.withColumn(output_col, spread).drop(top, bottom, own, first), output_col, smooth=smooth)


def _free(df: DataFrame, *names: str) -> list[str]:
    """Those names, each with as many underscores as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _mean_and_variance(weights: list, terms: list[str], w) -> tuple:
    """Mean and variance over a frame of a sum of weighted terms, whose weights are constant in it: from the terms' first and second moments."""
    mean = functools.reduce(operator.add, [k * F.avg(t).over(w) for k, t in zip(weights, terms, strict=True)])
    second = functools.reduce(operator.add, [j * k * F.avg(F.col(s) * F.col(t)).over(w) for j, s in zip(weights, terms, strict=True) for k, t in zip(weights, terms, strict=True)])
    return mean, second - mean * mean


def edge(df: DataFrame, open_col: str = "open", high_col: str = "high", low_col: str = "low", close_col: str = "close", window_type: str = "rolling", window_size: int = 30, sign: bool = False, output_col: str = "edge_spread") -> DataFrame:
    """Effective spread from open, high, low and close, after Ardia, Guidotti and Kroencke's efficient estimator.

    Two moment conditions give the squared spread each: products of the move from open to mid-range (or from the last close to it) with the move before. They
    are weighted by the other's variance. Moves are centred on bars that traded, and scaled by how often open and close lie off the extremes.
    Each condition's terms are linear in quantities of the bar, so its mean and variance come from window averages of those and of their products: native frames, no
    kernel. NULL below three bars or `window_size` ones, with fewer than two bars that traded, or if open or close never leave the extremes.
    """
    move = ["from_open", "to_open", "from_close", "to_close", "overnight"]
    lagged = _free(df, *[f"_edge_last_{x}" for x in ("high", "low", "close", "mid")])
    at, mid, traded, open_off, close_off = _free(df, "_edge_at", "_edge_mid", "_edge_traded", "_edge_open_off", "_edge_close_off")
    moves = dict(zip(move, _free(df, *[f"_edge_{x}" for x in move]), strict=True))
    price = dict(zip("ohlc", (open_col, high_col, low_col, close_col), strict=True))
    o, h, low, c = (F.log(price[x]) for x in "ohlc")
    last_high, last_low, last_close, last_mid = (F.col(x) for x in lagged)
    bars = df.withColumns({mid: (h + low) / 2, at: F.row_number().over(by_ticker())})
    bars = bars.withColumns({name: F.lag(x).over(by_ticker()) for name, x in zip(lagged, (h, low, c, F.col(mid)), strict=True)})
    one = lambda x: F.when(F.col(at) > 1, x.cast("double"))
    bars = bars.withColumns({
        traded: one((h != low) | (low != last_close)), moves["from_open"]: one(F.col(mid) - o), moves["to_open"]: one(o - last_mid), moves["from_close"]: one(F.col(mid) - last_close),
        moves["to_close"]: one(last_close - last_mid), moves["overnight"]: one(o - last_close),
    })
    bars = bars.withColumns({
        open_off: F.col(traded) * ((o != h).cast("double") + (o != low).cast("double")), close_off: F.col(traded) * ((last_close != last_high).cast("double") + (last_close != last_low).cast("double")),
    })
    w = by_ticker().rowsBetween(-(window_size - 2), 0) if window_type == "rolling" else frame("ts", window_type, window_size)
    mean = lambda x: F.avg(x).over(w)
    by_open, by_close = F.lit(-4.0) / F.nullif(mean(open_off), F.lit(0.0)), F.lit(-4.0) / F.nullif(mean(close_off), F.lit(0.0))
    drift = lambda x: mean(moves[x]) / F.nullif(mean(traded), F.lit(0.0))
    found = []
    for k, (then, second, before) in enumerate((("to_open", "from_close", "to_close"), ("overnight", "overnight", "to_close"))):
        parts = [F.col(moves["from_open"]) * F.col(moves[then]), F.col(traded) * F.col(moves[then]), F.col(moves[second]) * F.col(moves[before]), F.col(traded) * F.col(moves[before])]
        whole = functools.reduce(operator.and_, [x.isNotNull() for x in parts])
        terms = _free(df, *[f"_edge_term_{k}_{i}" for i in range(4)])
        bars = bars.withColumns({t: F.when(whole, x) for t, x in zip(terms, parts, strict=True)})
        found.append(([by_open, -by_open * drift("from_open"), by_close, -by_close * drift(second)], terms))
    (e1, v1), (e2, v2) = (_mean_and_variance(k, t, w) for k, t in found)
    names = _free(df, "_edge_e1", "_edge_v1", "_edge_e2", "_edge_v2", "_edge_n")
    bars = bars.withColumns(dict(zip(names, (e1, v1, e2, v2, F.sum(traded).over(w)), strict=True)))
    e1, v1, e2, v2, n = (F.col(x) for x in names)
    squared = F.when(v1 + v2 > 0, (v2 * e1 + v1 * e2) / (v1 + v2)).otherwise((e1 + e2) / 2)
    spread = F.sqrt(F.abs(squared)) * (F.signum(squared) if sign else F.lit(1.0))
    least = max(3, window_size) if window_type == "rolling" else 3
    out = bars.withColumn(output_col, F.when((F.col(at) >= least) & (n >= 2), clean(spread)))
    return out.select(*[x for x in df.columns if x != output_col], output_col)


liquidity = dispatch("liquidity", {"amihud": amihud, "edge": edge, "high_low_spread": high_low_spread, "notional_value": traded_value})


def _extreme(name: str, largest: bool):
    def op(df: DataFrame, return_col: str = "ret", window_size: int = 30, n_top: int | None = None, sign_flip: bool = False, output_col: str | None = None, smooth: int | None = None) -> DataFrame:
        out, w = output_col or f"{name}_{window_size}", frame("ts", "rolling", window_size)
        if n_top is None:
            x = AGGREGATES["max" if largest else "min"](F.col(return_col), w)
        else:
            df = df.withColumn("_seen", F.collect_list(return_col).over(w))
            some = F.slice(F.sort_array("_seen", asc=not largest), 1, n_top)
            x = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some))
        x = F.when(F.count(return_col).over(w) >= window_size, x)
        return finish(df.withColumn(out, x).drop("_seen"), out, sign_flip=sign_flip, smooth=smooth)

    return op


max_return, min_return = _extreme("Max", True), _extreme("Min", False)


def max_min(df: DataFrame, return_col: str = "ret", window_size: int = 30, n_top: int | None = None, sign_flip: bool = False) -> DataFrame:
    out = f"MaxMin_{window_size}"
    df = min_return(max_return(df, return_col, window_size, n_top, output_col="_hi"), return_col, window_size, n_top, output_col="_lo")
    return finish(df.withColumn(out, F.col("_hi") - F.abs("_lo")).drop("_hi", "_lo"), out, sign_flip=sign_flip)


def skew(df: DataFrame, return_col: str = "ret", window_size: int = 30, sign_flip: bool = False, smooth: int | None = None) -> DataFrame:
    out, w = f"Skew_{window_size}", frame("ts", "rolling", window_size)
    x = F.col(return_col)
    return finish(df.withColumn(out, F.when(F.count(x).over(w) >= window_size, g1(x, w))), out, sign_flip=sign_flip, smooth=smooth)


def iskew(df: DataFrame, return_col: str = "ret", factor_col: str = "market", window_size: int = 30, sign_flip: bool = False) -> DataFrame:
    out = f"ISkew_{window_size}"
    df = regress.idiosyncratic_returns(df, return_col, factor_col, "_i", window_size=window_size)
    return skew(df, "_i", window_size, sign_flip).withColumnRenamed(f"Skew_{window_size}", out).drop("_i")


skews = dispatch("skew", {"skew": skew, "max": max_return, "min": min_return, "max_min": max_min, "idio_skew": iskew})
