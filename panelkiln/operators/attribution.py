"""Exposures to factors, portfolios that mimic them, what returns owe to them, and cross-section regressions factor by factor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, TICKER, Window, by_ticker

#: Periods a year by the least average gap of dates in days: daily, weekly, monthly, quarterly, else yearly.
GAPS = ((3.5, 365), (14.0, 52), (45.0, 12), (135.0, 4))


def annual_factor(df: DataFrame, daily: int = 365) -> int:
    """Periods a year, from the average gap of the panel's dates."""
    r = df.agg(F.countDistinct(DATE).alias("n"), F.datediff(F.max(DATE), F.min(DATE)).alias("span")).first()
    gap = r["span"] / (r["n"] - 1) if r["n"] > 1 else 1.0
    found = next((a for least, a in GAPS if gap <= least), 1)
    return daily if found == 365 else found


def period_change(df: DataFrame, periods: int, ret_col: str = "ret", output_col: str = "pct_chg") -> DataFrame:
    """The compounded simple return of the last `periods` rows, NULL before there are more rows than that; missing returns are left out."""
    w = by_ticker().rowsBetween(-(periods - 1), 0)
    made = F.exp(F.sum(F.log1p(ret_col)).over(w)) - 1
    return df.withColumn(output_col, F.when(F.row_number().over(by_ticker()) > periods, made))


def exposures(df: DataFrame, return_col: str, factor_cols: list[str]) -> DataFrame:
    """ticker, factor, beta of each ticker's least squares with an intercept. Moments are aggregates by ticker; each row solves a system of the factors' size."""
    cols, k = [*factor_cols, return_col], len(factor_cols)
    rows = df.select(TICKER, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).dropna()
    sums = rows.groupBy(TICKER).agg(*[F.covar_pop(f"_{i}", f"_{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k + 1)], F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                g = np.array([[getattr(r, f"c{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)], float)
                beta = np.linalg.pinv(g) @ np.array([getattr(r, f"c{i}_{k}") for i in range(k)], float)
                out += [(r.ticker, f, float(v)) for f, v in zip(factor_cols, beta, strict=True)]
            yield pd.DataFrame(out, columns=["ticker", "factor", "beta"])

    return sums.filter(F.col("n") > k + 1).mapInPandas(run, "ticker string, factor string, beta double")


def mimicking_weights(df: DataFrame, return_col: str, factor_cols: list[str], method: str = "ols") -> DataFrame:
    """ticker, factor, weight: B (B'B)^-1 of the exposures B; with 'ml' S^-1 B (B' S^-1 B)^-1, S the covariance of returns.

    'ols' sums B'B in the cluster. 'ml' inverts a matrix of the tickers, so one task holds it and the panel's dates without a gap.
    """
    b = exposures(df, return_col, factor_cols)
    wide = b.groupBy(TICKER).pivot("factor", factor_cols).agg(F.first("beta"))
    if method == "ols":
        k = len(factor_cols)
        s = wide.agg(*[F.sum(F.col(a) * F.col(c)).alias(f"s{i}_{j}") for i, a in enumerate(factor_cols) for j, c in enumerate(factor_cols)]).first()
        inv = np.linalg.pinv(np.array([[s[f"s{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)], float))
        made = [F.struct(F.lit(f).alias("factor"), sum(F.col(a) * float(inv[i, j]) for i, a in enumerate(factor_cols)).alias("weight")) for j, f in enumerate(factor_cols)]
        return wide.select(TICKER, F.explode(F.array(*made)).alias("_p")).select(TICKER, "_p.factor", "_p.weight")
    if method != "ml":
        raise ValueError(f"no such method: {method}")

    def run(key, rets: pd.DataFrame, betas: pd.DataFrame) -> pd.DataFrame:
        r = rets.pivot(index=DATE, columns=TICKER, values="_r").dropna()
        beta = betas.set_index(TICKER)[factor_cols].reindex(r.columns).dropna()
        r = r[beta.index]
        if len(r) < 2 or not len(beta):
            return pd.DataFrame(columns=["ticker", "factor", "weight"])
        s, x = np.linalg.pinv(np.atleast_2d(np.cov(r.to_numpy("float64"), rowvar=False))), beta.to_numpy("float64")
        w = s @ x @ np.linalg.pinv(x.T @ s @ x)
        return pd.DataFrame([(t, f, w[i, j]) for i, t in enumerate(beta.index) for j, f in enumerate(factor_cols)], columns=["ticker", "factor", "weight"])

    one = F.lit(1).alias("_k")
    rets = df.select(one, DATE, TICKER, F.col(return_col).cast("double").alias("_r"))
    return rets.groupBy("_k").cogroup(wide.select(one, "*").groupBy("_k")).applyInPandas(run, "ticker string, factor string, weight double")


def mimicking_returns(df: DataFrame, return_col: str, factor_cols: list[str], method: str = "ols") -> DataFrame:
    """date, factor, ret of the portfolios that mimic the factors, over the dates' names with returns."""
    w = mimicking_weights(df, return_col, factor_cols, method)
    return df.filter(F.col(return_col).isNotNull()).join(w, TICKER).groupBy(DATE, "factor").agg(F.sum(F.col(return_col) * F.col("weight")).alias("ret"))


def attribute(df: DataFrame, return_col: str = "ret", factor_col: str = "market") -> DataFrame:
    """Adds beta_ret (the ticker's beta times the factor) and alpha_ret (the rest), over rows that have both values."""
    w = Window.partitionBy(TICKER)
    x = F.when(F.col(factor_col).isNotNull(), F.col(return_col).cast("double"))
    f = F.when(F.col(return_col).isNotNull(), F.col(factor_col).cast("double"))
    part = F.covar_samp(x, f).over(w) / F.nullif(F.var_samp(f).over(w), F.lit(0.0)) * f
    return df.withColumn("beta_ret", part).withColumn("alpha_ret", x - F.col("beta_ret"))


def covariance_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, covariance) of each pair of columns, one pass."""
    one = df.agg(*[F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}_{j}").alias("covariance")) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def from_full_dates(df: DataFrame, cols: list[str], min_obs: int = 10) -> DataFrame:
    """Rows from the first date on that has more than min_obs names with all columns; an error where there is none."""
    some = df.dropna(subset=cols).groupBy(DATE).count().filter(F.col("count") > min_obs).agg(F.min(DATE).alias("d")).first()["d"]
    if some is None:
        raise ValueError("no date has that many names")
    return df.filter(F.col(DATE) >= F.lit(some))


def fama_macbeth_each(df: DataFrame, return_col: str, factor_cols: list[str], lags: int = 1, min_obs: int = 10) -> DataFrame:
    """factor, beta, std_error, t_stat: each factor alone, each date's slope through the origin, then their mean over dates. No kernel."""
    y = F.col("_y")
    rows = df.select(DATE, TICKER, F.col(return_col).cast("double").alias("_y"), *[F.lag(c, lags).over(by_ticker()).cast("double").alias(c) for c in factor_cols])
    rows = from_full_dates(rows, ["_y", *factor_cols], min_obs)
    slope = lambda c: F.sum(F.when(y.isNotNull(), F.col(c) * y)) / F.nullif(F.sum(F.when(y.isNotNull(), F.col(c) * F.col(c))), F.lit(0.0))
    daily = rows.groupBy(DATE).agg(*[slope(c).alias(c) for c in factor_cols])
    long = daily.select(F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("b")) for c in factor_cols])).alias("p")).select("p.*")
    error = F.stddev_samp("b") / F.sqrt(F.count("b").cast("double"))
    return long.groupBy("factor").agg(F.avg("b").alias("beta"), error.alias("std_error"), (F.avg("b") / F.nullif(error, F.lit(0.0))).alias("t_stat"))


def pooled_each(df: DataFrame, return_col: str, factor_cols: list[str], lags: int = 1) -> DataFrame:
    """factor, beta, r2 of pooled regressions on each factor alone, with an intercept; one pass."""
    rows = df.select(F.col(return_col).cast("double").alias("_y"), *[F.lag(c, lags).over(by_ticker()).cast("double").alias(c) for c in factor_cols])
    one = rows.agg(*[f(F.col("_y"), F.col(c)).alias(f"{n}{i}") for i, c in enumerate(factor_cols) for n, f in (("b", F.regr_slope), ("r", F.regr_r2))])
    pairs = [F.struct(F.lit(c).alias("factor"), F.col(f"b{i}").alias("beta"), F.col(f"r{i}").alias("r2")) for i, c in enumerate(factor_cols)]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def lowdin(cov: np.ndarray) -> np.ndarray:
    """The symmetric turn of (a stack of) covariances, rescaled to the columns' own deviations. Directions without variance (columns that depend on others) are left out."""
    v, e = np.linalg.eigh(cov)
    some = v > 1e-10 * np.maximum(v[..., -1:], 1e-300)
    sd = np.sqrt(np.diagonal(cov, axis1=-2, axis2=-1))
    return (e * np.where(some, np.where(some, v, 1.0) ** -0.5, 0.0)[..., None, :]) @ np.swapaxes(e, -1, -2) * sd[..., None, :]


def orthogonalize_windows(df: DataFrame, factor_cols: list[str], window_type: str = "fixed", window_size: int = 365, min_obs: int = 30) -> DataFrame:
    """date, ticker and {factor}_orth of the rows with all factors: each row turned by its window's covariance, along each ticker.

    Windows' moments are differences of running sums and all turns of a ticker are one batched decomposition. Rows before a full window have none.
    """
    k, names = len(factor_cols), [f"{c}_orth" for c in factor_cols]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        x = pdf[factor_cols].to_numpy("float64")
        x, n = x - (x.mean(0) if len(x) else 0), len(x)
        first = {"fixed": 0, "rolling": window_size - 1, "expanding": min_obs - 1}[window_type]
        if n < 2 or n <= first:
            return pd.DataFrame({DATE: pdf[DATE][:0], TICKER: pdf[TICKER][:0]} | {c: np.zeros(0) for c in names})
        end = np.arange(first, n) + 1
        if window_type == "fixed":
            mean, cov = np.zeros((1, k)), np.cov(x, rowvar=False).reshape(1, k, k)
        else:
            s1 = np.concatenate([np.zeros((1, k)), np.cumsum(x, 0)])
            s2 = np.concatenate([np.zeros((1, k, k)), np.cumsum(x[:, :, None] * x[:, None, :], 0)])
            start = end - window_size if window_type == "rolling" else np.zeros_like(end)
            m = (end - start).astype("float64")[:, None]
            mean = (s1[end] - s1[start]) / m
            cov = ((s2[end] - s2[start]) - m[:, :, None] * mean[:, :, None] * mean[:, None, :]) / (m[:, :, None] - 1)
        turned = np.einsum("nk,nkj->nj", x[first:] - mean, np.broadcast_to(lowdin(cov), (n - first, k, k)))
        return pd.DataFrame({DATE: pdf[DATE].to_numpy()[first:], TICKER: pdf[TICKER].to_numpy()[first:]} | {c: turned[:, i] for i, c in enumerate(names)})

    rows = df.select(DATE, TICKER, *[F.col(c).cast("double").alias(c) for c in factor_cols]).dropna()
    return rows.groupBy(TICKER).applyInPandas(run, f"date date, ticker string, {', '.join(f'`{c}` double' for c in names)}")


def summary(df: DataFrame, value_col: str = "value", start_value: float = 1.0, ann_factor: int = 365) -> DataFrame:
    """One row of an account's values by date: total_return, annualized_return, annualized_vol, sharpe_ratio, periods."""
    one = df.select(DATE, F.lit("account").alias(TICKER), F.col(value_col).alias("_v"))  # a row per date of the calendar
    one = one.withColumn("_r", F.col("_v") / F.lag("_v").over(by_ticker()) - 1)
    a = float(ann_factor)
    return one.agg(
        (F.max_by("_v", DATE) / start_value - 1).alias("total_return"), (F.avg("_r") * a).alias("annualized_return"), (F.stddev_samp("_r") * a**0.5).alias("annualized_vol"),
        (F.avg("_r") * a**0.5 / F.nullif(F.stddev_samp("_r"), F.lit(0.0))).alias("sharpe_ratio"), F.count("_v").alias("periods"),
    )


def period_rate(rate: Column | str, ann_factor: int = 365) -> Column:
    """A yearly rate as the continuous rate of one period."""
    return F.log1p(rate) / ann_factor
