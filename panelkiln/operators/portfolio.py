"""Universe, market return, weights, optimizers, rebalancing, costs and backtests."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, TICKER, Window, frame, safe_div, windowed
from panelkiln.operators import risk


def liquidity_filter(df: DataFrame, price_col: str = "close", volume_col: str = "volume", filter_col: str = "signal", window_type: str = "rolling", window_size: int = 30, smooth: bool = True, thresh: float = 1e6, top: int | None = None) -> DataFrame:
    """filter_col NULL for names whose notional value is below the threshold, or that aren't among a date's `top` by it (equal ones by ticker)."""
    df = df.withColumn("_v", F.col(price_col) * F.col(volume_col))
    if smooth:
        df = windowed(df, "_v", "_nv", "mean", "ts", window_type, window_size, 1)
    else:
        df = df.withColumn("_nv", F.col("_v"))
    if top is None:
        ok = F.col("_nv") >= thresh
    else:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(DATE).orderBy(F.desc_nulls_last("_nv"), TICKER)))
        ok = F.col("_r") <= top
    return df.withColumn(filter_col, F.when(ok, F.col(filter_col))).drop("_v", "_nv", "_r")


def market_return(df: DataFrame, return_col: str = "ret", weight_col: str | None = None, output_col: str = "market") -> DataFrame:
    w = Window.partitionBy(DATE)
    return df.withColumn(output_col, F.sum(F.col(return_col) * F.col(weight_col)).over(w) if weight_col else F.avg(return_col).over(w))


def weights(df: DataFrame, metric_col: str, output_col: str = "weight") -> DataFrame:
    """Over the date's sum of absolute values (1e-9 where that is 0)."""
    total = F.sum(F.abs(F.col(metric_col))).over(Window.partitionBy(DATE))
    return df.withColumn(output_col, F.col(metric_col) / F.when(total == 0, 1e-9).otherwise(total))


def equal_weight(df: DataFrame, signal_col: str = "signal", output_col: str = "weight") -> DataFrame:
    n = F.count(F.when(F.col(signal_col) != 0, 1)).over(Window.partitionBy(DATE))
    return df.withColumn(output_col, safe_div(F.col(signal_col), n))


def signal_weight(df: DataFrame, signal_col: str = "signal", output_col: str = "weight") -> DataFrame:
    return df.withColumn(output_col, safe_div(F.col(signal_col), F.sum(F.abs(F.col(signal_col))).over(Window.partitionBy(DATE))))


def inverse_risk(df: DataFrame, return_col: str = "ret", window_size: int = 30, power: int = 1, output_col: str = "weight") -> DataFrame:
    """By inverse volatility (power 1) or variance (2) of a rolling window."""
    w = frame("ts", "rolling", window_size)
    inv = F.when(F.count(return_col).over(w) >= window_size, safe_div(F.lit(1.0), F.pow(F.stddev_samp(return_col).over(w), F.lit(float(power)))))
    df = df.withColumn("_i", inv)
    return df.withColumn(output_col, F.col("_i") / F.sum("_i").over(Window.partitionBy(DATE))).drop("_i")


def target_vol_weight(df: DataFrame, return_col: str = "ret", window_size: int = 30, ann_vol: float = 0.15, ann_factor: int = 365, output_col: str = "weight") -> DataFrame:
    df = inverse_risk(df, return_col, window_size, 1, output_col)
    vol = F.stddev_samp(return_col).over(frame("ts", "rolling", window_size)) * math.sqrt(ann_factor)
    return df.withColumn(output_col, F.col(output_col) * safe_div(F.lit(ann_vol), vol))


def adjust_exposure(df: DataFrame, weight_col: str = "weight", gross: float | None = None, net: float | None = None) -> DataFrame:
    w = Window.partitionBy(DATE)
    if gross is not None:
        df = df.withColumn(weight_col, safe_div(F.col(weight_col) * gross, F.sum(F.abs(F.col(weight_col))).over(w)))
    if net is not None:
        df = df.withColumn(weight_col, F.col(weight_col) + (net - F.sum(weight_col).over(w)) / F.count(weight_col).over(w))
    return df


def round_weights(df: DataFrame, weight_col: str = "weight", step: float = 1e-4) -> DataFrame:
    x = F.col(weight_col)
    return df.withColumn(weight_col, F.floor(F.abs(x) / step) * step * F.signum(x))


def commission(df: DataFrame, weight_col: str = "weight", rate: float = 0.001, output_col: str = "cost") -> DataFrame:
    """rate * |change of weight|; a name that is new or gone changes from or to 0."""
    last = F.coalesce(F.lag(weight_col).over(Window.partitionBy(TICKER).orderBy(DATE)), F.lit(0.0))
    return df.withColumn(output_col, F.abs(F.coalesce(weight_col, F.lit(0.0)) - last) * rate)


def portfolio_returns(df: DataFrame, weight_col: str = "weight", return_col: str = "ret", lags: int = 1, rate: float = 0.0) -> DataFrame:
    """date, gross, cost, net of weights held from `lags` rows before."""
    w = Window.partitionBy(TICKER).orderBy(DATE)
    df = commission(df.withColumn("_w", F.lag(weight_col, lags).over(w)), "_w", rate, "_cost")
    out = df.groupBy(DATE).agg(F.sum(F.col("_w") * F.col(return_col)).alias("gross"), F.sum("_cost").alias("cost"))
    return out.withColumn("net", F.coalesce("gross", F.lit(0.0)) - F.col("cost"))


# Optimizers on one window's moments


def _simplex(v: np.ndarray, budget: float = 1.0, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """The nearest weights in the box that sum to the budget."""
    if low == 0 and 0 < budget <= high:  # the upper bound can't hold, so sorting finds the shift at once
        u = np.sort(v)[::-1]
        over = (np.cumsum(u) - budget) / np.arange(1, len(u) + 1)
        return np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0.0)
    a, b = (v - high).min() - 1, (v - low).max() + 1
    for _ in range(100):
        t = (a + b) / 2
        if np.clip(v - t, low, high).sum() > budget:
            a = t
        else:
            b = t
    return np.clip(v - (a + b) / 2, low, high)


def _descend(grad, n: int, step: float, budget: float = 1.0, low: float = 0.0, high: float = 1.0, rounds: int = 2000) -> np.ndarray:
    """Accelerated projected gradient from equal weights."""
    w = y = _simplex(np.full(n, budget / n), budget, low, high)
    t = 1.0
    for _ in range(rounds):
        new = _simplex(y - step * grad(y), budget, low, high)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-12:
            break
        w, t = new, t2
    return w


def min_vol(cov: np.ndarray, **box) -> np.ndarray:
    """Weights sum to the budget."""
    return _descend(lambda w: 2 * cov @ w, len(cov), 0.5 / max(np.linalg.eigvalsh(cov)[-1], 1e-18), **box)


def mean_variance(mu: np.ndarray, cov: np.ndarray, risk_aversion: float = 1.0, **box) -> np.ndarray:
    return _descend(lambda w: 2 * risk_aversion * cov @ w - mu, len(mu), 0.5 / max(risk_aversion * np.linalg.eigvalsh(cov)[-1], 1e-18), **box)


def max_return(mu: np.ndarray, high: float = 1.0, budget: float = 1.0) -> np.ndarray:
    w, left = np.zeros(len(mu)), budget
    for i in np.argsort(-mu, kind="stable"):
        w[i] = min(high, left)
        left -= w[i]
    return w


def max_diversification(cov: np.ndarray, **box) -> np.ndarray:
    w = min_vol(risk.to_corr(cov), **box) / np.sqrt(np.diag(cov))
    return w / w.sum()


def max_sharpe(mu: np.ndarray, cov: np.ndarray, rf: float = 0.0) -> np.ndarray:
    """The best of the frontier over risk aversions, without shorts."""
    found = [mean_variance(mu - rf, cov, a) for a in np.geomspace(1e-2, 1e4, 25)]
    return max(found, key=lambda w: (w @ (mu - rf)) / math.sqrt(max(w @ cov @ w, 1e-18)))


def efficient_return(mu: np.ndarray, cov: np.ndarray, goal: float) -> np.ndarray:
    """Least risk with at least the return asked for, by bisection over risk aversion; the largest return where it can't be had."""
    a, b = 1e-4, 1e6
    for _ in range(60):
        m = math.sqrt(a * b)
        a, b = (m, b) if mean_variance(mu, cov, m, rounds=500) @ mu >= goal else (a, m)
    return mean_variance(mu, cov, a)


def efficient_risk(mu: np.ndarray, cov: np.ndarray, goal: float) -> np.ndarray:
    """Largest return with at most the volatility asked for; the least risk where it can't be had."""
    a, b = 1e-4, 1e6
    for _ in range(60):
        m = math.sqrt(a * b)
        w = mean_variance(mu, cov, m, rounds=500)
        a, b = (a, m) if math.sqrt(max(w @ cov @ w, 0)) <= goal else (m, b)
    return mean_variance(mu, cov, b)


def risk_parity(cov: np.ndarray, budget: float = 1.0) -> np.ndarray:
    """Equal risk contributions: cyclic coordinate descent on w' cov w / 2 - mean of ln w."""
    n = len(cov)
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(1000):
        old = w.copy()
        for i in range(n):
            b = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-b + math.sqrt(b * b + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(w - old).max() < 1e-12:
            break
    return budget * w / w.sum()


def linkage(dist: np.ndarray, method: str = "single") -> list[tuple[int, int, float, int]]:
    """Agglomerative clustering: (left, right, distance, size), clusters numbered from n on."""
    n = len(dist)
    d = {(i, j): dist[i, j] for i in range(n) for j in range(i + 1, n)}
    size, out = {i: 1 for i in range(n)}, []
    for k in range(n, 2 * n - 1):
        (a, b), v = min(d.items(), key=lambda x: (x[1], x[0]))
        out.append((a, b, v, size[a] + size[b]))
        get = lambda i, j: d[min(i, j), max(i, j)]
        for c in list(size):
            if c not in (a, b):
                x, y, na, nb, nc = get(a, c), get(b, c), size[a], size[b], size[c]
                d[c, k] = {"single": min(x, y), "complete": max(x, y), "average": (na * x + nb * y) / (na + nb), "ward": math.sqrt(((na + nc) * x * x + (nb + nc) * y * y - nc * v * v) / (na + nb + nc))}[method]
        size[k] = size.pop(a) + size.pop(b)
        d = {p: x for p, x in d.items() if a not in p and b not in p}
    return out


def leaves(tree: list, n: int, k: int | None = None) -> list[int]:
    """Leaves of a cluster in the order of the tree."""
    k = n + len(tree) - 1 if k is None else k
    if k < n:
        return [k]
    a, b = tree[k - n][:2]
    return leaves(tree, n, a) + leaves(tree, n, b)


def _cluster_risk(cov: np.ndarray, at: list[int], measure: str = "variance", r: np.ndarray | None = None, alpha: float = 0.05) -> float:
    iv = 1 / np.diag(cov)[at]
    w = iv / iv.sum()
    var = float(w @ cov[np.ix_(at, at)] @ w)
    if measure == "variance":
        return var
    if measure == "std":
        return math.sqrt(var)
    p = r[:, at] @ w
    if measure == "expected_shortfall":
        return float(-p[p <= np.quantile(p, alpha)].mean())
    c = np.cumprod(1 + p)
    dd = np.minimum.accumulate(c / np.maximum.accumulate(c) - 1)
    return float(-dd[dd <= np.quantile(dd, alpha)].mean())


def hrp(r: np.ndarray, method: str = "single", measure: str = "variance") -> np.ndarray:
    """Hierarchical risk parity: split along the order of the tree's leaves, by inverse risk of the halves."""
    cov = risk.covariance(r)
    n = len(cov)
    order = leaves(linkage(np.sqrt(np.maximum((1 - risk.to_corr(cov)) / 2, 0)), method), n) if n > 1 else [0]
    w, todo = np.ones(n), [order]
    while todo:
        at = todo.pop()
        if len(at) < 2:
            continue
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        ra, rb = _cluster_risk(cov, a, measure, r), _cluster_risk(cov, b, measure, r)
        share = 1 - ra / (ra + rb)
        w[a] *= share
        w[b] *= 1 - share
        todo += [a, b]
    return w


def optimal_clusters(dist: np.ndarray, tree: list, most: int = 10, seeds: int = 10) -> int:
    """By the gap between the spread within clusters and that of uniform points."""
    n = len(dist)

    def spread(d: np.ndarray, t: list, k: int) -> float:
        return math.log(max(sum((d[np.ix_(c, c)] ** 2).sum() / (2 * len(c)) for c in clusters(t, n, k)), 1e-12))

    best, gaps = 1, []
    rng = np.random.default_rng(0)
    refs = []
    for _ in range(seeds):
        p = rng.random((n, min(n, 5))) * dist.max()
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        refs.append((d, linkage(d, "ward")))
    for k in range(1, min(most, n) + 1):
        ref = np.array([spread(d, t, k) for d, t in refs])
        gaps.append((ref.mean() - spread(dist, tree, k), ref.std() * math.sqrt(1 + 1 / seeds)))
        if k > 1 and gaps[-2][0] >= gaps[-1][0] - gaps[-1][1]:
            return k - 1
        best = k
    return best


def clusters(tree: list, n: int, k: int) -> list[list[int]]:
    top = {n + len(tree) - 1} if n > 1 else {0}
    while len(top) < k:
        x = max(top)
        top.remove(x)
        top |= set(tree[x - n][:2])
    return [leaves(tree, n, x) for x in sorted(top)]


def herc(r: np.ndarray, method: str = "ward", measure: str = "variance", k: int | None = None) -> np.ndarray:
    """Hierarchical equal risk contribution: by inverse risk down the tree to k clusters, inverse variance within."""
    cov = risk.covariance(r)
    n = len(cov)
    if n == 1:
        return np.ones(1)
    dist = np.sqrt(np.maximum((1 - risk.to_corr(cov)) / 2, 0))
    tree = linkage(dist, method)
    k = k or optimal_clusters(dist, tree)
    ends = {tuple(sorted(c)) for c in clusters(tree, n, k)}
    w, todo = np.ones(n), [n + len(tree) - 1]
    while todo:
        x = todo.pop()
        at = leaves(tree, n, x)
        if tuple(sorted(at)) in ends:
            iv = 1 / np.diag(cov)[at]
            w[at] *= iv / iv.sum()
            continue
        a, b = tree[x - n][:2]
        ra, rb = _cluster_risk(cov, leaves(tree, n, a), measure, r), _cluster_risk(cov, leaves(tree, n, b), measure, r)
        w[leaves(tree, n, a)] *= rb / (ra + rb)
        w[leaves(tree, n, b)] *= ra / (ra + rb)
        todo += [a, b]
    return w


def expected_returns(r: np.ndarray, method: str = "historical_mean", window: int = 30, ann_factor: int | None = None) -> np.ndarray:
    last = r[-window:]
    down = np.where(last < 0, last, np.nan)
    with np.errstate(all="ignore"):
        mu = {
            "historical_mean": lambda: np.nanmean(r, 0), "historical_median": lambda: np.nanmedian(r, 0), "rolling_mean": lambda: np.nanmean(last, 0), "rolling_median": lambda: np.nanmedian(last, 0),
            "ewma": lambda: pd.DataFrame(r).ewm(span=window).mean().to_numpy()[-1], "rolling_sharpe": lambda: np.nanmean(last, 0) / np.nanstd(last, 0, ddof=1), "rolling_sortino": lambda: np.nanmean(last, 0) / np.nanstd(down, 0, ddof=1),
        }[method]()
    if ann_factor:
        mu = mu * (math.sqrt(ann_factor) if method in ("rolling_sharpe", "rolling_sortino") else ann_factor)
    return mu


def round_corner(w: np.ndarray, threshold: float = 1e-4) -> np.ndarray:
    """Weights that are all but in one name become exactly that name; others stay."""
    corner = np.zeros_like(w)
    corner[np.argmax(w)] = 1
    return corner if (np.abs(w - corner) <= threshold).all() else w


OPTIMIZERS = {
    "equal_weight": lambda r, s, c: np.full(r.shape[1], 1 / r.shape[1]),
    "inverse_variance": lambda r, s, c: (1 / np.diag(c)) / (1 / np.diag(c)).sum(),
    "inverse_volatility": lambda r, s, c: np.diag(c) ** -0.5 / (np.diag(c) ** -0.5).sum(),
    "random": lambda r, s, c: np.random.default_rng(0).dirichlet(np.ones(r.shape[1])),
    "max_return": lambda r, s, c: max_return(s),
    "min_vol": lambda r, s, c: min_vol(c),
    "mean_variance": lambda r, s, c: mean_variance(s, c),
    "max_sharpe": lambda r, s, c: max_sharpe(s, c),
    "max_diversification": lambda r, s, c: max_diversification(c),
    "risk_parity": lambda r, s, c: risk_parity(c),
    "hrp": lambda r, s, c: hrp(r),
    "herc": lambda r, s, c: herc(r),
}


def windowed_weights(df: DataFrame, return_col: str = "ret", method: str = "min_vol", window_size: int = 60, every: int = 20, estimator: str = "covariance", signal_col: str | None = None, leverage: float = 1.0, expanding: bool = False, least_share: float = 0.5) -> DataFrame:
    """(date, ticker, weight) at the date of the first full window and every n-th date after it, from the window of dates that ends there.

    Dates are numbered over the panel's calendar and cut in blocks of window_size; a date's rows are sent to the blocks whose windows hold it (two copies at
    most, unless expanding), and a block's windows are one kernel: blocks run side by side. Names with fewer returns than `least_share` of the window's dates
    aren't weighted; a missing return counts as none.
    """
    days = df.select(DATE).filter(F.col(DATE).isNotNull()).distinct()
    days = days.withColumn("_n", F.row_number().over(Window.orderBy(DATE)) - 1)  # one row per date of the calendar
    signal = F.col(signal_col).cast("double") if signal_col else F.lit(None).cast("double")
    rows = df.join(days, DATE).select(DATE, TICKER, F.col(return_col).cast("double").alias("_r"), signal.alias("_s"), "_n")
    last = days.agg(F.max("_n")).first()[0] or 0
    final = F.lit(last // window_size)
    last_block = final if expanding else F.least(F.floor((F.col("_n") + window_size - 1) / window_size), final)
    sent = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_n") / window_size), last_block)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["_b"].iloc[0])
        panel = pdf.pivot(index="_n", columns=TICKER, values="_r").sort_index()
        signals = pdf.pivot(index="_n", columns=TICKER, values="_s").sort_index() if signal_col else None
        out = [pd.DataFrame({"_n": pd.Series(dtype="int64"), TICKER: pd.Series(dtype="object"), "weight": pd.Series(dtype="float64")})]
        for end in range(max(b * window_size, window_size - 1), min((b + 1) * window_size - 1, last) + 1):
            if (end - window_size + 1) % every:
                continue
            start = 0 if expanding else end - window_size + 1
            wide = panel.loc[start:end]
            wide = wide.loc[:, wide.notna().mean() >= least_share].fillna(0.0)
            r = wide.to_numpy()
            wide = wide.loc[:, r.std(0) > 0] if len(r) else wide
            r = wide.to_numpy()
            if r.shape[1] == 0 or len(r) < 2:
                continue
            c = risk.ESTIMATORS[estimator](r)
            s = signals.loc[start:end].ffill().iloc[-1].reindex(wide.columns).to_numpy() if signal_col else expected_returns(r)
            w = OPTIMIZERS[method](r, s, c)
            w = w * leverage / np.abs(w).sum()
            out.append(pd.DataFrame({"_n": end, TICKER: wide.columns, "weight": w}))
        return pd.concat(out[1:] or out)

    # the number of partitions is given, as small rows with long kernels would else be gathered in a few tasks
    made = sent.repartition(last // window_size + 1, "_b").groupBy("_b").applyInPandas(run, "_n long, ticker string, weight double")
    return made.join(days, "_n").select(DATE, TICKER, "weight")


def backtest(df: DataFrame, weights_df: DataFrame, return_col: str = "ret", rate: float = 0.001, start_value: float = 1.0, funding_col: str | None = None) -> DataFrame:
    """date, value, ret, cost, turnover: weights drift with returns between the dates that set them.

    The account is a recursion over dates, so it is one kernel: it runs on the calendar's rows (a row per date, names gathered as arrays), which is what one task gets.
    """
    held = df.join(weights_df.withColumnRenamed("weight", "_w"), [DATE, TICKER], "left")
    r = F.coalesce(F.col(return_col), F.lit(0.0)) - (F.coalesce(F.col(funding_col), F.lit(0.0)) if funding_col else F.lit(0.0))
    daily = held.groupBy(DATE).agg(F.array_sort(F.collect_list(F.struct(F.col(TICKER).alias("t"), r.cast("double").alias("r"), F.col("_w").alias("w")))).alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value, w, rows = start_value, {}, []
        for d, x in pdf.sort_values(DATE)[[DATE, "x"]].itertuples(index=False):
            r = {p["t"]: p["r"] for p in x}
            gain = sum(v * r.get(t, 0.0) for t, v in w.items())
            w = {t: v * (1 + r.get(t, 0.0)) / (1 + gain) for t, v in w.items()} if gain > -1 else {}
            new = {p["t"]: p["w"] for p in x if p["w"] is not None and not math.isnan(p["w"])}
            turnover = sum(abs(new.get(t, 0.0) - w.get(t, 0.0)) for t in set(new) | set(w)) if new else 0.0
            cost = rate * turnover * value * (1 + gain)
            before, value = value, value * (1 + gain) - cost
            w = new or w
            rows.append((d, value, value / before - 1, cost, turnover))
        return pd.DataFrame(rows, columns=["date", "value", "ret", "cost", "turnover"])

    return daily.groupBy(F.lit(1).alias("_k")).applyInPandas(lambda pdf: run(pdf), "date date, value double, ret double, cost double, turnover double")


def is_rebalance_day(date: dt.date, freq: str | int, n: int = 0) -> bool:
    """The calendar rule for one date, as signals.rebalance_days has it for columns."""
    if isinstance(freq, int):
        return n % freq == 0
    end = (date + dt.timedelta(days=1)).day == 1
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    return {"daily": True, "15th": date.day == 15, "month_start": date.day == 1, "month_end": end, "quarter_end": end and date.month % 3 == 0}.get(freq, freq in days and date.weekday() == days.index(freq))
