"""Portfolio sorts, cross-sectional regressions, information coefficients and contingency statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, TICKER, Window, by_ticker, frame
from panelkiln.operators import windows


def quantize_factors(df: DataFrame, bins: dict[str, int], conditional: bool = False, axis: str = "cs") -> DataFrame:
    """A column {factor}_q for each factor: bins of its own, or within the bins of the factors before it."""
    keys = [DATE]
    for c, n in bins.items():
        if conditional:
            x = F.col(c)
            w = Window.partitionBy(*keys)
            place = F.rank().over(w.orderBy(x.asc_nulls_last())) + (F.count(x).over(Window.partitionBy(*keys, x)) - 1) / 2
            df = df.withColumn(f"{c}_q", F.when(x.isNotNull(), F.ceil(F.round(place / F.count(x).over(w) * float(n), 9))).cast("double"))
            keys.append(f"{c}_q")
        else:
            df = windows.quantize(df, c, f"{c}_q", n, axis=axis)
    return df


def portfolio_sort(df: DataFrame, bins: dict[str, int], return_col: str = "ret", lags: int = 1, conditional: bool = False, statistic: str = "mean") -> DataFrame:
    """date, one bin column per factor, ret, n: the return of each cell's names by their bins of `lags` rows before."""
    df = quantize_factors(df, bins, conditional)
    names = [f"{c}_q" for c in bins]
    df = df.withColumns({f"_{q}": F.lag(q, lags).over(by_ticker()) for q in names})
    some = df.filter(F.col(return_col).isNotNull())
    for q in names:
        some = some.filter(F.col(f"_{q}").isNotNull())
    made = F.avg(return_col) if statistic == "mean" else F.percentile(return_col, F.lit(0.5))
    return some.groupBy(DATE, *[F.col(f"_{q}").alias(q) for q in names]).agg(made.alias("ret"), F.count(F.lit(1)).alias("n"))


def long_short(sorted_df: DataFrame, bin_col: str, top: float, bottom: float = 1.0) -> DataFrame:
    """The top bin's return less the bottom bin's, on dates with both."""
    hi = F.max(F.when(F.col(bin_col) == top, F.col("ret")))
    lo = F.max(F.when(F.col(bin_col) == bottom, F.col("ret")))
    return sorted_df.groupBy(DATE).agg((hi - lo).alias("ret")).filter("ret is not null")


def information_coefficient(df: DataFrame, factor_col: str, return_col: str = "ret", lags: int = 1, least: int = 3) -> DataFrame:
    """Each date's Spearman correlation of the factor of `lags` rows before with the return."""
    df = df.withColumn("_f", F.lag(factor_col, lags).over(by_ticker())).filter(F.col("_f").isNotNull() & F.col(return_col).isNotNull())
    df = windows.rank(windows.rank(df, "_f", "_a", axis="cs", min_periods=1), return_col, "_b", axis="cs", min_periods=1)
    spread = F.stddev_pop("_a") * F.stddev_pop("_b")
    some = df.groupBy(DATE).agg(F.covar_pop("_a", "_b").alias("_c"), spread.alias("_s"), F.count(F.lit(1)).alias("n"))
    return some.select(DATE, F.when((F.col("_s") > 0) & (F.col("n") >= least), F.col("_c") / F.nullif("_s", F.lit(0.0))).alias("ic"), "n")


def rolling_ic(df: DataFrame, factor_col: str, return_col: str = "ret", window_size: int = 30) -> DataFrame:
    ic = information_coefficient(df, factor_col, return_col).withColumn(TICKER, F.lit("ic"))
    return ic.withColumn("rolling_ic", F.avg("ic").over(frame("ts", "rolling", window_size))).drop(TICKER)


def fama_macbeth(df: DataFrame, return_col: str, factor_cols: list[str], lags: int = 1, least: int = 3) -> DataFrame:
    """factor, mean, se, t, n of each date's cross-section coefficients, regressed without an intercept."""
    lagged = df.select(DATE, F.col(return_col).cast("double").alias("_y"), *[F.lag(c, lags).over(by_ticker()).cast("double").alias(c) for c in factor_cols])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.dropna()
        if len(x) < max(least, len(factor_cols)):
            return pd.DataFrame(columns=["factor", "b"])
        b, *_ = np.linalg.lstsq(x[factor_cols].to_numpy(), x["_y"].to_numpy(), rcond=None)
        return pd.DataFrame({"factor": factor_cols, "b": b})

    daily = lagged.groupBy(DATE).applyInPandas(run, "factor string, b double")
    n = F.count("b").cast("double")
    return daily.groupBy("factor").agg(F.avg("b").alias("mean"), (F.stddev_samp("b") / F.sqrt(n)).alias("se"), (F.avg("b") / (F.stddev_samp("b") / F.sqrt(n))).alias("t"), F.count("b").alias("n"))


def pooled_regression(df: DataFrame, return_col: str, factor_cols: list[str], lags: int = 1) -> DataFrame:
    """factor, coef by ordinary least squares over all rows: the moments are summed in the cluster, the driver solves a system of their size."""
    names = ["_1", *factor_cols]
    rows = df.select(F.lit(1.0).alias("_1"), F.col(return_col).cast("double").alias("_y"), *[F.lag(c, lags).over(by_ticker()).cast("double").alias(c) for c in factor_cols]).dropna()
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a in names for b in [*names, "_y"]], F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    xx = np.array([[sums[f"{a}|{b}"] or 0.0 for b in names] for a in names])
    xy = np.array([sums[f"{a}|_y"] or 0.0 for a in names])
    b = np.linalg.pinv(xx) @ xy
    s2 = max((sums["yy"] or 0.0) - b @ xy, 0) / max(sums["n"] - len(names), 1)
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(xx)) * s2, 0))
    made = [("const" if c == "_1" else c, float(v), float(e), float(v / e) if e else None) for c, v, e in zip(names, b, se, strict=True)]
    return df.sparkSession.createDataFrame(made, "factor string, coef double, se double, t double")


def orthogonalize(df: DataFrame, factor_cols: list[str]) -> DataFrame:
    """Symmetric orthogonalisation over the whole sample, rescaled to the factors' own deviations: columns {factor}_orth."""
    k = len(factor_cols)
    one = df.dropna(subset=factor_cols).agg(*[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(factor_cols) for j, b in enumerate(factor_cols)], *[F.avg(a).alias(f"m{i}") for i, a in enumerate(factor_cols)]).first()
    c = np.array([[one[f"c{i}_{j}"] for j in range(k)] for i in range(k)], float)
    v, e = np.linalg.eigh(c)
    s = e @ np.diag(np.maximum(v, 1e-18) ** -0.5) @ e.T @ np.diag(np.sqrt(np.diag(c)))
    return df.withColumns({f"{f}_orth": sum((F.col(a) - float(one[f"m{i}"])) * float(s[i, j]) for i, a in enumerate(factor_cols)) for j, f in enumerate(factor_cols)})


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, chi2, cramers_v, tschuprow_t, pearson_c, mutual_information of two binned columns. Counts are by cell; no pair of rows is made."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    cells = cells.withColumns({"_r": F.sum("o").over(Window.partitionBy("_a")), "_c": F.sum("o").over(Window.partitionBy("_b"))})
    total = cells.agg(F.sum("o").alias("n"))
    x = cells.join(F.broadcast(total), F.lit(True)).agg(
        F.max("n").alias("n"), (F.max("n") * (F.sum(F.col("o") * F.col("o") / (F.col("_r") * F.col("_c"))) - 1)).alias("chi2"),
        F.countDistinct("_a").alias("r"), F.countDistinct("_b").alias("c"), F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("_r") * F.col("_c")))).alias("mutual_information"),
    )
    phi = F.col("chi2") / F.col("n")
    least = F.least("r", "c") - 1
    return x.select("n", "chi2", F.sqrt(phi / F.nullif(least, F.lit(0))).alias("cramers_v"), F.sqrt(phi / F.nullif(F.sqrt(((F.col("r") - 1) * (F.col("c") - 1)).cast("double")), F.lit(0.0))).alias("tschuprow_t"), F.sqrt(F.col("chi2") / (F.col("chi2") + F.col("n"))).alias("pearson_c"), "mutual_information")


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted pairs of points ordered alike less those ordered contrarily; ties count 0. Points are distinct. By merging halves: n log n."""
    at = np.lexsort((y, x))
    x, y, w = x[at], y[at], w[at].astype("float64")

    def halves(a: int, b: int) -> tuple[float, np.ndarray]:
        """For a stretch: the sum over pairs by place, and the places in the order of y."""
        if b - a <= 64:
            s = np.sign(y[None, a:b] - y[a:b, None]) * w[a:b, None] * w[None, a:b]
            return float(np.triu(s, 1).sum()), a + np.argsort(y[a:b], kind="stable")
        mid = (a + b) // 2
        (s, left), (t, right) = halves(a, mid), halves(mid, b)
        sums = np.concatenate([[0.0], np.cumsum(w[left])])
        low, high = np.searchsorted(y[left], y[right], "left"), np.searchsorted(y[left], y[right], "right")
        cross = (w[right] * (sums[low] - (sums[-1] - sums[high]))).sum()
        both = np.concatenate([left, right])
        return s + t + float(cross), both[np.argsort(y[both], kind="stable")]

    if not len(x):
        return 0.0
    total = halves(0, len(x))[0]
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))  # equal x: ordered by y above, so counted as alike
    return total - float(((np.add.reduceat(w, starts) ** 2 - np.add.reduceat(w * w, starts)) / 2).sum())


def kendall_tau(df: DataFrame, a: str, b: str) -> DataFrame:
    """ticker, tau: tau-b along each ticker, NULL without two different values on both sides. Equal points are counted first."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy("float64") for c in ("_a", "_b", "_w"))
        pairs = lambda n: float((n * (n - 1) / 2).sum())
        whole = pairs(np.array([w.sum()]))
        tied = [pairs(np.bincount(np.unique(v, return_inverse=True)[1], w)) for v in (x, y)]
        scale = (whole - tied[0]) * (whole - tied[1])
        return pd.DataFrame({"ticker": [pdf[TICKER].iloc[0]], "tau": [concordance(x, y, w) / math.sqrt(scale) if scale > 0 else np.nan]})

    points = df.select(TICKER, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).dropna(subset=["_a", "_b"])
    return points.groupBy(TICKER, "_a", "_b").agg(F.count(F.lit(1)).alias("_w")).groupBy(TICKER).applyInPandas(run, "ticker string, tau double")


def factor_mimicking(r: np.ndarray, exposures: np.ndarray, method: str = "ols") -> np.ndarray:
    """Weights (assets by factors) of portfolios that mimic factors, from exposures of the assets."""
    if method == "ols":
        return exposures @ np.linalg.pinv(exposures.T @ exposures)
    s = np.linalg.pinv(np.cov(r, rowvar=False))
    return s @ exposures @ np.linalg.pinv(exposures.T @ s @ exposures)


