"""Principal components (plain, windowed and aligned, probabilistic), and forecasts by penalised regressions refitted over time."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, TICKER, by_ticker


def _wide(pdf: pd.DataFrame, value: str) -> pd.DataFrame:
    return pdf.pivot(index=DATE, columns=TICKER, values=value).sort_index()


def fit_pca(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, loadings (assets by components, the first's sum not negative) and explained shares of standardised columns."""
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    v = vt[:k].T
    v = v * np.where(v.sum(0) < 0, -1.0, 1.0)
    return z @ v, v, (s**2 / (s**2).sum())[:k]


def align(v: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order and signs of components that match those of the window before best: largest sum of |products|."""
    m = before.T @ v
    k = m.shape[0]
    if k <= 7:
        order = max(permutations(range(k)), key=lambda p: sum(abs(m[i, p[i]]) for i in range(k)))
    else:  # greedy for many components
        left, order = set(range(k)), []
        for i in range(k):
            j = max(left, key=lambda c: abs(m[i, c]))
            order.append(j)
            left.remove(j)
    order = np.array(order)
    return order, np.where(m[np.arange(k), order] < 0, -1.0, 1.0)


def pca(df: DataFrame, value_col: str = "ret", n_components: int = 2) -> DataFrame:
    """component, ticker, loading, explained of complete dates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _wide(pdf, value_col).dropna()
        _, v, e = fit_pca(w.to_numpy(float), n_components)
        return pd.DataFrame([(i + 1, t, v[j, i], e[i]) for i in range(v.shape[1]) for j, t in enumerate(w.columns)], columns=["component", "ticker", "loading", "explained"])

    return df.select(DATE, TICKER, value_col).groupBy(F.lit(1).alias("_k")).applyInPandas(lambda pdf: run(pdf), "component long, ticker string, loading double, explained double")


def windowed_pca(df: DataFrame, value_col: str = "ret", window_size: int = 120, every: int = 1, n_components: int = 2, expanding: bool = False, aligned: bool = True) -> DataFrame:
    """date, component, score, explained at each date from the first full window on, components matched to the window before where `aligned`.

    Windows are of all dates, and each has the names without a gap in it (dates that all names miss aside). Where these are fewer than components, it has the
    names with any value, on its dates without a gap; where those dates aren't more than components, it gives no rows. They end at every n-th date; the dates between are scored with the loadings, mean and deviation of the last one. A score is NULL where its date
    lacks a value. Matching, on the names that both windows have, makes windows depend on each other, so one kernel walks over them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _wide(pdf, value_col)
        x, before, rows = w.to_numpy(float), None, []
        for i in range(window_size - 1, len(x), every):
            past = x[0 if expanding else i - window_size + 1 : i + 1]
            past = past[~np.isnan(past).all(1)]
            at = np.flatnonzero(~np.isnan(past).any(0))
            if len(at) < n_components:
                at = np.flatnonzero(~np.isnan(past).all(0))
                past = past[~np.isnan(past[:, at]).any(1)]
            if min(len(past) - 1, len(at)) < n_components:
                continue
            past = past[:, at]
            _, v, e = fit_pca(past, n_components)
            if aligned and before is not None:
                order, sign = align(v, before[at])
                v, e = v[:, order] * sign, e[order]
            before = np.zeros((x.shape[1], v.shape[1]))
            before[at] = v
            sd = past.std(0)
            scores = (x[i : i + every, at] - past.mean(0)) / np.where(sd > 0, sd, 1) @ v
            rows += [(w.index[i + j], k + 1, y[k], e[k]) for j, y in enumerate(scores) for k in range(v.shape[1])]
        return pd.DataFrame(rows, columns=["date", "component", "score", "explained"])

    return df.select(DATE, TICKER, value_col).groupBy(F.lit(1).alias("_k")).applyInPandas(lambda pdf: run(pdf), "date date, component long, score double, explained double")


def fit_ppca(x: np.ndarray, k: int, tol: float = 1e-4, rounds: int = 500, seed: int = 0) -> np.ndarray:
    """Loadings by expectation and maximisation; missing values are estimated on the way."""
    gone = ~np.isfinite(x)
    mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    z = np.where(gone, 0, (x - mean) / np.where(sd > 0, sd, 1))
    c, noise = np.random.default_rng(seed).standard_normal((z.shape[1], k)), 1.0
    for _ in range(rounds):
        inv = np.linalg.inv(c.T @ c + noise * np.eye(k))
        s = z @ c @ inv
        z = np.where(gone, s @ c.T, z)
        new = z.T @ s @ np.linalg.inv(s.T @ s + len(z) * noise * inv)
        noise = max(((z - s @ new.T) ** 2).mean() + noise * np.trace(new @ inv @ new.T) / z.shape[1], 1e-12)
        done, c = np.abs(new - c).max() < tol, new
        if done:
            break
    q, _ = np.linalg.qr(c)
    val, vec = np.linalg.eigh(np.cov(z @ q, rowvar=False))
    v = q @ vec[:, ::-1]
    return v * np.where(v.sum(0) < 0, -1.0, 1.0)


def ppca(df: DataFrame, value_col: str = "ret", n_components: int = 2) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _wide(pdf, value_col).dropna(how="all")
        v = fit_ppca(w.to_numpy(float), n_components)
        return pd.DataFrame([(i + 1, t, v[j, i]) for i in range(v.shape[1]) for j, t in enumerate(w.columns)], columns=["component", "ticker", "loading"])

    return df.select(DATE, TICKER, value_col).groupBy(F.lit(1).alias("_k")).applyInPandas(lambda pdf: run(pdf), "component long, ticker string, loading double")


def coordinate_descent(x: np.ndarray, y: np.ndarray, alpha: float, l1_ratio: float = 1.0, rounds: int = 1000) -> np.ndarray:
    """Elastic net on centred data; l1_ratio 1 is the lasso."""
    n, b = len(y), np.zeros(x.shape[1])
    norm, e = (x**2).sum(0) / n, y.copy()
    for _ in range(rounds):
        old = b.copy()
        for j in range(len(b)):
            g = x[:, j] @ e / n + norm[j] * b[j]
            new = np.sign(g) * max(abs(g) - alpha * l1_ratio, 0) / (norm[j] + alpha * (1 - l1_ratio) or 1)
            e += x[:, j] * (b[j] - new)
            b[j] = new
        if np.abs(b - old).max(initial=0) < 1e-10:
            break
    return b


def fit_linear(x: np.ndarray, y: np.ndarray, model: str, alpha: float = 0.01) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of standardised features, given back in their own units."""
    m, s = x.mean(0), x.std(0)
    s = np.where(s > 0, s, 1)
    z, c, scale = (x - m) / s, y - y.mean(), y.std() or 1
    if model == "ols":
        b = np.linalg.lstsq(z, c, rcond=None)[0]
    elif model == "ridge":
        b = np.linalg.solve(z.T @ z + alpha * len(y) * np.eye(z.shape[1]), z.T @ c)
    elif model in ("lasso", "elastic_net"):
        b = coordinate_descent(z, c / scale, alpha, 1.0 if model == "lasso" else 0.5) * scale
    else:
        raise ValueError(f"no such model: {model}")
    b = b / s
    return b, y.mean() - m @ b


def forecast(df: DataFrame, target_col: str, feature_cols: list[str], model: str = "ols", window_size: int = 120, every: int = 20, expanding: bool = False, alpha: float = 0.01) -> DataFrame:
    """date, ticker, prediction of the next row's target from this row's features, refitted at every n-th row on the window before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE).reset_index(drop=True)
        data = pdf.assign(_y=pdf[target_col].shift(-1))[[*feature_cols, "_y"]].astype("float64").to_numpy()
        out, b = [], None
        for i in range(window_size, len(data)):
            if (i - window_size) % every == 0:
                past = data[0 if expanding else i - window_size : i]
                past = past[np.isfinite(past).all(1)]
                b = fit_linear(past[:, :-1], past[:, -1], model, alpha) if len(past) > len(feature_cols) + 1 else None
            if b is not None and np.isfinite(data[i, :-1]).all():
                out.append((pdf[DATE][i], pdf[TICKER][i], data[i, :-1] @ b[0] + b[1]))
        return pd.DataFrame(out, columns=["date", "ticker", "prediction"])

    return df.groupBy(TICKER).applyInPandas(run, "date date, ticker string, prediction double")


def scores(df: DataFrame, actual_col: str, predicted_col: str = "prediction") -> DataFrame:
    """mse, rmse, mae, r2 and the share of rows where both change in the same direction from the row before, per ticker, of rows with both values."""
    e = F.col(actual_col) - F.col(predicted_col)
    df = df.dropna(subset=[actual_col, predicted_col])
    change = lambda c: F.signum(F.col(c) - F.lag(c).over(by_ticker()))
    df = df.withColumn("_same", (change(actual_col) == change(predicted_col)).cast("double"))
    return df.groupBy(TICKER).agg(
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(actual_col) * F.count(e), F.lit(0.0))).alias("r2"),
        F.avg("_same").alias("chg_accuracy"),
    )


def param_grid(df: DataFrame, operator, grid: dict[str, list], score) -> list[tuple[dict, float]]:
    """Each combination of parameters with its score, best first. score: panel -> a plan of one number; all are one job."""
    from itertools import product

    combos = [dict(zip(grid, v, strict=True)) for v in product(*grid.values())]
    if not combos:
        return []
    plans = [score(operator(df, **c)).toDF("score").select(F.lit(i).alias("i"), F.col("score").cast("double")) for i, c in enumerate(combos)]
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    found = {r["i"]: r["score"] for r in out.collect()}
    return sorted(((c, found.get(i)) for i, c in enumerate(combos)), key=lambda x: (x[1] is None, -(x[1] or 0)))


