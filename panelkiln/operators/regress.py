"""Regressions along a ticker: betas, residuals, tests for unit roots and for causality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, TICKER, Window, by_ticker, frame


def _pairs(df: DataFrame, y: str, x: str, window_size: int) -> DataFrame:
    """Rows with both values, of tickers that have a window of them."""
    some = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).select(DATE, TICKER, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    return some.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(TICKER))).filter(F.col("_n") >= window_size).drop("_n")


def _line(df: DataFrame, y: str, x: str, window_type: str, n: int) -> DataFrame:
    """Adds _a and _b of the line through each row's window; windows are of the rows that have both values."""
    p, w = _pairs(df, y, x, n if window_type == "rolling" else 2), frame("ts", window_type, n)
    full = F.count(F.lit(1)).over(w) >= (n if window_type == "rolling" else 2)
    b = F.covar_samp("_y", "_x").over(w) / F.nullif(F.var_samp("_x").over(w), F.lit(0.0))
    p = p.withColumn("_b", F.when(full, b)).withColumn("_a", F.avg("_y").over(w) - F.col("_b") * F.avg("_x").over(w))
    return df.join(p.select(DATE, TICKER, "_a", "_b"), [DATE, TICKER], "left")


def betas(df: DataFrame, target_col: str, feature_col: str, output_col: str = "beta", window_type: str = "rolling", window_size: int = 60) -> DataFrame:
    return _line(df, target_col, feature_col, window_type, window_size).withColumn(output_col, F.col("_b")).drop("_a", "_b")


def intercepts(df: DataFrame, target_col: str, feature_col: str, output_col: str = "alpha", window_type: str = "rolling", window_size: int = 60) -> DataFrame:
    return _line(df, target_col, feature_col, window_type, window_size).withColumn(output_col, F.col("_a")).drop("_a", "_b")


def residuals(df: DataFrame, target_col: str, feature_col: str, output_col: str = "residual", window_type: str = "rolling", window_size: int = 360) -> DataFrame:
    """y - (a + b x) with the line of the window that ends at the row."""
    out = _line(df, target_col, feature_col, window_type, window_size)
    return out.withColumn(output_col, F.col(target_col) - (F.col("_a") + F.col("_b") * F.col(feature_col))).drop("_a", "_b")


def ols(y: np.ndarray, x: np.ndarray, intercept: bool = True, hac_lags: int | None = None) -> dict:
    """Least squares with the usual statistics; standard errors are robust to autocorrelation where hac_lags is given."""
    X = np.column_stack([np.ones(len(y)), x]) if intercept else np.asarray(x, float).reshape(len(y), -1)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    e = y - X @ beta
    n, k = X.shape
    inv = np.linalg.pinv(X.T @ X)
    if hac_lags is None:
        cov = inv * (e @ e / max(n - k, 1))
    else:
        g = X * e[:, None]
        s = g.T @ g
        for lag in range(1, hac_lags + 1):
            c = g[lag:].T @ g[:-lag]
            s += (1 - lag / (hac_lags + 1)) * (c + c.T)
        cov = inv @ s @ inv
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    total = ((y - y.mean()) ** 2).sum() if intercept else (y**2).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / se
    return {"params": beta, "se": se, "t": t, "p": np.array([two_sided_t(v, max(n - k, 1)) for v in t]), "resid": e, "fitted": X @ beta, "rsquared": 1 - e @ e / total if total > 0 else np.nan, "n": n}


def two_sided_t(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's method, two terms a round.
    away = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d = 1.0, 1 / away(1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + term * d), away(1 + term / c)
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return min(1.0, max(0.0, front * f))


def rolling_multi_ols(df: DataFrame, target_col: str, feature_cols: list[str], output_prefix: str = "beta", window_type: str = "rolling", window_size: int = 60) -> DataFrame:
    """Coefficients of several features (prefix_const, prefix_feature), residual and r2 of each row's window, by normal equations in one pass over a ticker."""
    names = [f"{output_prefix}_{c}" for c in ["const", *feature_cols]] + [f"{output_prefix}_resid", f"{output_prefix}_r2"]
    schema = df.drop(*names).schema
    for n in names:
        schema = schema.add(n, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE, kind="stable").reset_index(drop=True)
        data = pdf[[target_col, *feature_cols]].astype("float64").to_numpy()
        ok = np.flatnonzero(np.isfinite(data).all(1))
        y, X = data[ok, 0], np.column_stack([np.ones(len(ok)), data[ok, 1:]])
        out = np.full((len(pdf), len(names)), np.nan)
        k = X.shape[1]
        for j in range(len(ok)):
            if window_type == "fixed":
                a, b = 0, len(ok)
            else:
                a, b = (max(0, j + 1 - window_size) if window_type == "rolling" else 0), j + 1
            if b - a < (window_size if window_type == "rolling" else k + 1):
                continue
            r = ols(y[a:b], X[a:b, 1:])
            out[ok[j]] = [*r["params"], y[j] - X[j] @ r["params"], max(0.0, r["rsquared"])]
        for i, n in enumerate(names):
            pdf[n] = out[:, i]
        return pdf[[f.name for f in schema]]

    return df.groupBy(TICKER).applyInPandas(run, schema)


def idiosyncratic_returns(df: DataFrame, return_col: str = "ret", factor_col: str = "market", output_col: str = "idio_ret", incl_alpha: bool = True, window_type: str = "rolling", window_size: int = 30, own_return: bool = True) -> DataFrame:
    """With incl_alpha the return less beta times the return itself (own_return) or the factor; else the residual of the line."""
    if not incl_alpha:
        return residuals(df, return_col, factor_col, output_col, window_type, window_size)
    out = betas(df, return_col, factor_col, "_beta", window_type, window_size)
    return out.withColumn(output_col, F.col(return_col) - F.col("_beta") * F.col(return_col if own_return else factor_col)).drop("_beta")


def ticker_ols(df: DataFrame, target_col: str, feature_cols: list[str]) -> DataFrame:
    """One row per ticker and term: coefficient, standard error, t, p, r2, n over the whole sample."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values(DATE)[[target_col, *feature_cols]].astype("float64").dropna().to_numpy()
        if len(data) <= len(feature_cols) + 1:
            return pd.DataFrame(columns=["ticker", "term", "coef", "se", "t", "p", "r2", "n"])
        r = ols(data[:, 0], data[:, 1:])
        return pd.DataFrame({"ticker": pdf[TICKER].iloc[0], "term": ["const", *feature_cols], "coef": r["params"], "se": r["se"], "t": r["t"], "p": r["p"], "r2": r["rsquared"], "n": len(data)})

    return df.groupBy(TICKER).applyInPandas(run, "ticker string, term string, coef double, se double, t double, p double, r2 double, n long")


#: MacKinnon's response surface for critical values with a constant (1%, 5%, 10%): limit and terms in 1/n, 1/n^2, 1/n^3.
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def adf(y: np.ndarray, max_lag: int | None = None) -> dict:
    """Augmented Dickey-Fuller test with a constant; the number of lags has the least AIC."""
    y = np.asarray(y, float)
    most = max_lag if max_lag is not None else min(int(math.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 2)
    d = np.diff(y)

    def fit(lags: int, start: int) -> tuple[dict, float]:
        X = np.column_stack([y[start:-1], *[d[start - k : len(d) - k] for k in range(1, lags + 1)]])
        r = ols(d[start:], X)
        e = r["resid"]
        return r, len(e) * math.log(max(e @ e / len(e), 1e-300)) + 2 * (lags + 2)

    best = min(range(most + 1), key=lambda k: fit(k, most)[1])
    r, _ = fit(best, best)
    n = r["n"]
    return {"stat": float(r["t"][1]), "lags": best, "n": n, **{f"crit_{k}": c[0] + c[1] / n + c[2] / n**2 + c[3] / n**3 for k, c in ADF_CRITICAL.items()}}


def adf_test(df: DataFrame, input_col: str) -> DataFrame:
    """One row per ticker: statistic, lags, n, critical values."""
    names = ["stat", "lags", "n", "crit_1%", "crit_5%", "crit_10%"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(DATE)[input_col].astype("float64").dropna().to_numpy()
        if len(y) < 12 or y.std() == 0:
            return pd.DataFrame(columns=["ticker", "stat", "lags", "n", "crit_1", "crit_5", "crit_10"])
        r = adf(y)
        return pd.DataFrame([[pdf[TICKER].iloc[0], *[r[k] for k in names]]], columns=["ticker", "stat", "lags", "n", "crit_1", "crit_5", "crit_10"])

    return df.groupBy(TICKER).applyInPandas(run, "ticker string, stat double, lags long, n long, crit_1 double, crit_5 double, crit_10 double")


def granger(df: DataFrame, target_col: str, cause_col: str, max_lag: int = 4) -> DataFrame:
    """One row per ticker and lag: F statistic of adding the cause's lags, and its p-value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values(DATE)[[target_col, cause_col]].astype("float64").dropna().to_numpy()
        rows = []
        for k in range(1, max_lag + 1):
            n = len(data) - k
            if n <= 2 * k + 1:
                break
            y = data[k:, 0]
            own = np.column_stack([data[k - j : len(data) - j, 0] for j in range(1, k + 1)])
            both = np.column_stack([own, *[data[k - j : len(data) - j, 1] for j in range(1, k + 1)]])
            a, b = ols(y, own)["resid"], ols(y, both)["resid"]
            free = n - 2 * k - 1
            f = ((a @ a - b @ b) / k) / (b @ b / free) if b @ b > 0 else math.inf
            rows.append((pdf[TICKER].iloc[0], k, f, incomplete_beta(free / 2, k / 2, free / (free + k * f)) if math.isfinite(f) else 0.0))
        return pd.DataFrame(rows, columns=["ticker", "lag", "f", "p"])

    return df.groupBy(TICKER).applyInPandas(run, "ticker string, lag long, f double, p double")


def time_index(df: DataFrame, output_col: str = "_time") -> DataFrame:
    return df.withColumn(output_col, F.row_number().over(by_ticker()).cast("double"))
