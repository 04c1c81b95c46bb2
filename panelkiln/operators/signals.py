"""Signals from scores, quantiles and ranks; targets; holding between rebalance dates; costs and returns of signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, TICKER, Window, by_ticker, frame, safe_div
from panelkiln.operators import scalars, windows
from panelkiln.operators.base import dispatch

#: Abramowitz and Stegun 7.1.26, the error function to 1.5e-7.
_ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function without leaving the JVM, to 1e-7."""
    p, *a = _ERF
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + p * z)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    e = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + e) / 2).otherwise((1 - e) / 2)


def finish(df: DataFrame, x: Column, output_col: str = "signal", lags: int | None = None, direction: str | None = None, leverage: float | None = None) -> DataFrame:
    """Lag, keep one direction, lever."""
    if lags:
        df = df.withColumn("_x", x)
        x = F.lag("_x", lags).over(by_ticker())
    if direction == "long":
        x = F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    elif direction == "short":
        x = F.when(x.isNotNull(), F.least(x, F.lit(0.0)))
    return df.withColumn(output_col, x * float(leverage) if leverage else x).drop("_x")


MAPPINGS = {
    "norm": lambda x: norm_cdf(x) * 2 - 1,
    "logistic": lambda x: 2 / (1 + F.exp(-x)) - 1,
    "adj_norm": lambda x: x * F.exp(-x * x / 4) / 0.89,
    "tanh": lambda x: F.tanh(x),
    "ecdf": lambda x: x * 2 - 1,
    "min_max": lambda x: x * 2 - 1,
    "percentile": lambda x: x * 2 - 1,
    "rank_tanh": lambda x: F.tanh(2 * (x * 2 - 1)),
}


def score_signal(df: DataFrame, input_col: str = "zscore", mapping: str = "norm", **rest) -> DataFrame:
    return finish(df, MAPPINGS[mapping](F.col(input_col)), **rest)


def buy_hold(df: DataFrame, input_col: str = "ret", **rest) -> DataFrame:
    return finish(df, F.signum(F.abs(F.col(input_col))), **rest)


def raw_signal(df: DataFrame, input_col: str, **rest) -> DataFrame:
    return finish(df, F.col(input_col), **rest)


def sign_signal(df: DataFrame, input_col: str = "score", **rest) -> DataFrame:
    return finish(df, F.signum(F.col(input_col)), **rest)


def _spread(df: DataFrame, input_col: str, axis: str, bins: int | None, rest: dict) -> DataFrame:
    x, w = F.col(input_col), Window.partitionBy(DATE if axis == "cs" else TICKER)
    low, high = F.min(x).over(w), F.max(x).over(w)
    value = safe_div(x - low, high - low) * 2 - 1
    if axis == "cs" and bins:
        value = F.when(F.count(x).over(w) >= bins, value)
    return finish(df, value, **rest)


def quantile_signal(df: DataFrame, input_col: str = "quantile", axis: str = "ts", bins: int | None = None, **rest) -> DataFrame:
    """-1 to 1 by place between the least and largest, of the ticker's whole sample (which looks ahead) or the date."""
    return _spread(df, input_col, axis, bins, rest)


def rank_signal(df: DataFrame, input_col: str = "rank", axis: str = "ts", bins: int | None = None, **rest) -> DataFrame:
    return _spread(df, input_col, axis, bins, rest)


def discrete_zscore(df: DataFrame, input_col: str = "score", long_z_score: float = 1.5, short_z_score: float = -1.5, **rest) -> DataFrame:
    x = F.col(input_col)
    return finish(df, F.when(x >= long_z_score, 1.0).when(x <= short_z_score, -1.0).when(x.isNotNull(), 0.0), **rest)


def discrete_quantile(df: DataFrame, input_col: str = "quantile", **rest) -> DataFrame:
    """1 at the panel's largest value, -1 at its least."""
    ends = df.agg(F.min(input_col).alias("_lo"), F.max(input_col).alias("_hi"))
    x = F.col(input_col)
    df = df.join(F.broadcast(ends), F.lit(True))
    return finish(df, F.when(x == F.col("_hi"), 1.0).when(x == F.col("_lo"), -1.0).when(x.isNotNull(), 0.0), **rest).drop("_lo", "_hi")


def discrete_rank(df: DataFrame, input_col: str = "rank", n_assets: int = 10, **rest) -> DataFrame:
    """Of dates with more than 2n names the n highest ranks and the n lowest."""
    x, w = F.col(input_col), Window.partitionBy(DATE)
    value = F.when(x >= F.max(x).over(w) - n_assets, 1.0).when(x <= F.min(x).over(w) + n_assets, -1.0).when(x.isNotNull(), 0.0)
    return finish(df, F.when(F.count(x).over(w) > 2 * n_assets, value), **rest)


generate = dispatch(
    "signal",
    {"buy_hold": buy_hold, "raw": raw_signal, "score": score_signal, "quantile": quantile_signal, "rank": rank_signal, "sign": sign_signal, "discrete_zscore": discrete_zscore, "discrete_quantile": discrete_quantile, "discrete_rank": discrete_rank},
)


def threshold(df: DataFrame, input_col: str = "signal", at: float = 0.6, output_col: str = "signal") -> DataFrame:
    x = F.col(input_col)
    return df.withColumn(output_col, F.when(F.abs(x) >= at, F.signum(x)).when(x.isNotNull(), 0.0))


def combine(df: DataFrame, input_cols: list[str], method: str = "mean", output_col: str = "combined") -> DataFrame:
    """Across columns, NULLs left out."""
    some = F.filter(F.array(*[F.col(c).cast("double") for c in input_cols]), lambda v: v.isNotNull())
    n = F.size(some)
    total = F.aggregate(some, F.lit(0.0), lambda a, v: a + v)
    ordered = F.array_sort(some)
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    product = F.aggregate(some, F.lit(1.0), lambda a, v: a * v)
    made = {"mean": total / n, "sum": total, "min": F.array_min(some), "max": F.array_max(some), "median": median, "prod": product}[method]
    return df.withColumn(output_col, F.when(n > 0, made))


def rebalance_days(date: Column, freq: str | int, number: Column | None = None) -> Column:
    """Whether a date is one to rebalance at: daily, a weekday's name, 15th, month_start, month_end, quarter_end, or every n-th."""
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    if isinstance(freq, int):
        return (number % freq) == 0
    if freq in days:
        return F.weekday(date) == days.index(freq)
    known = {"daily": F.lit(True), "15th": F.dayofmonth(date) == 15, "month_start": F.dayofmonth(date) == 1, "month_end": F.last_day(date) == date, "quarter_end": (F.last_day(date) == date) & (F.month(date) % 3 == 0)}
    if freq not in known:
        raise ValueError(f"no such frequency: {freq}")
    return known[freq]


def rebalance(df: DataFrame, freq: str | int, input_col: str = "signal", output_col: str = "signal") -> DataFrame:
    """The value of the last rebalance date, held until the next."""
    number = F.row_number().over(by_ticker()) - 1
    df = df.withColumn("_held", F.when(rebalance_days(F.col(DATE), freq, number), F.col(input_col)))
    return df.withColumn(output_col, F.last("_held", ignorenulls=True).over(frame("ts", "expanding"))).drop("_held")


def signal_returns(df: DataFrame, signal_col: str = "signal", return_col: str = "ret", lags: int = 1, t_cost: float = 0.0, freq: str | int | None = None) -> DataFrame:
    """gross, cost and net of holding the lagged signal, less what changing it costs."""
    if freq is not None:
        df = rebalance(df, freq, signal_col, signal_col)
    held = F.lag(signal_col, lags).over(by_ticker()) if lags else F.col(signal_col)
    df = df.withColumn("_held", held)
    cost = F.abs(F.col("_held") - F.coalesce(F.lag("_held").over(by_ticker()), F.lit(0.0))) * t_cost
    return df.withColumns({"gross": F.col("_held") * F.col(return_col), "cost": cost}).withColumn("net", F.col("gross") - F.col("cost")).drop("_held")


def signal_dispersion(df: DataFrame, signal_col: str = "signal", method: str = "sign") -> DataFrame:
    x = F.col(signal_col)
    n = F.count(x).cast("double")
    made = {"sign": F.sum(F.signum(x)) / n, "std": F.stddev_samp(x), "skew": F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)), "range": F.max(x) - F.min(x)}[method]
    return df.filter(x.isNotNull()).groupBy(DATE).agg(made.alias("dispersion"))


def correlation(df: DataFrame, cols: list[str], method: str = "spearman") -> DataFrame:
    """(a, b, correlation) of each pair of columns over the whole panel, one pass; Spearman's is of ranks within dates."""
    if method == "spearman":
        for c in cols:
            df = windows.rank(df, c, f"_r_{c}", axis="cs", percentile=True, min_periods=1)
        name = lambda c: f"_r_{c}"
    else:
        name = lambda c: c
    one = df.agg(*[F.corr(name(a), name(b)).alias(f"{a}|{b}") for a in cols for b in cols])
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("correlation")) for a in cols for b in cols]))
    return one.select(pairs.alias("p")).select("p.*")


def signal_chain(df: DataFrame, factor_cols: list[str], axis: str = "ts", norm_method: str = "zscore", mapping: str = "norm", window_type: str = "expanding", window_size: int = 360, winsorize: float | None = 3, combine_method: str = "mean", quantile_bins: int | None = None, **rest) -> DataFrame:
    """Normalise factors, combine them, optionally quantise, map to a signal."""
    for c in factor_cols:
        params = {"winsorize": winsorize} if norm_method in ("zscore", "z-score", "robust_zscore", "mod_zscore") else {}
        df = windows.normalize(df, norm_method, input_col=c, output_col=f"_n_{c}", axis=axis, window_type=window_type, window_size=window_size, min_periods=3, **params)
    df = combine(df, [f"_n_{c}" for c in factor_cols], combine_method, "score").drop(*[f"_n_{c}" for c in factor_cols])
    if quantile_bins:
        df = windows.quantize(df, "score", "quantile", quantile_bins, axis=axis, window_type=window_type, window_size=window_size)
        return quantile_signal(df, "quantile", axis, quantile_bins, **rest)
    return score_signal(df, "score", mapping, **rest)


def dual_signals(df: DataFrame, factor_cols: list[str], summary_stat: str = "mean", norm_method: str = "zscore", mapping: str = "norm", window_type: str = "expanding", window_size: int = 360, winsorize: float | None = 3, combine_method: str = "mean", **rest) -> DataFrame:
    """Each factor normalised along its ticker and across its date, where it has both, summed up by `summary_stat`; these combined and mapped to a signal."""
    params = {"winsorize": winsorize} if norm_method in ("zscore", "z-score", "robust_zscore", "mod_zscore") else {}
    for c in factor_cols:
        for axis in ("ts", "cs"):
            df = windows.normalize(df, norm_method, input_col=c, output_col=f"_{axis}_{c}", axis=axis, window_type=window_type, window_size=window_size, min_periods=3, **params)
        df = combine(df, [f"_ts_{c}", f"_cs_{c}"], summary_stat, f"_n_{c}")
        df = df.withColumn(f"_n_{c}", F.when(F.col(f"_ts_{c}").isNotNull() & F.col(f"_cs_{c}").isNotNull(), F.col(f"_n_{c}"))).drop(f"_ts_{c}", f"_cs_{c}")
    df = combine(df, [f"_n_{c}" for c in factor_cols], combine_method, "score").drop(*[f"_n_{c}" for c in factor_cols])
    return score_signal(df, "score", mapping, **rest)


def target(df: DataFrame, price_col: str = "close", method: str = "log", lead: int = 1, output_col: str = "target") -> DataFrame:
    """The change over the next `lead` rows."""
    df = scalars.returns(df, {"simple": "pct", "log": "log", "diff": "diff"}[method], input_col=price_col, output_col="_c", lags=lead)
    return df.withColumn(output_col, F.lead("_c", lead).over(by_ticker())).drop("_c")
