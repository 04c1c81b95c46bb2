"""Performance of return series: one row per ticker (or portfolio) and metric; rolling forms as columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, TICKER, Window, frame, safe_div
from panelkiln.operators.base import dispatch


def cumulative_returns(df: DataFrame, ret_col: str = "ret", output_col: str = "cum_ret", ret_type: str = "simple") -> DataFrame:
    growth = F.log1p(F.col(ret_col)) if ret_type == "simple" else F.col(ret_col)
    return df.withColumn(output_col, F.exp(F.sum(growth).over(frame("ts", "expanding"))) - 1)


def drawdown(df: DataFrame, ret_col: str = "ret", output_col: str = "drawdown", ret_type: str = "simple") -> DataFrame:
    w = frame("ts", "expanding")
    df = cumulative_returns(df, ret_col, "_c", ret_type)
    return df.withColumn(output_col, (1 + F.col("_c")) / F.max(1 + F.col("_c")).over(w) - 1).drop("_c")


def excess_returns(df: DataFrame, rates: DataFrame, ret_col: str = "ret", rate_col: str = "rf", ann_factor: int = 365, output_col: str = "excess_ret") -> DataFrame:
    """Less the rate of the last date that has one (yearly, made continuous and divided by the periods of a year)."""
    df = df.join(rates.select(DATE, F.col(rate_col).alias("_rf")), DATE, "left")
    held = F.last("_rf", ignorenulls=True).over(frame("ts", "expanding"))
    return df.withColumn(output_col, F.col(ret_col) - F.log1p(held) / ann_factor).drop("_rf")


def _columns(r: str, a: float, ret_type: str, alpha: float) -> dict:
    x = F.col(r)
    n = F.count(x).cast("double")
    mean, sd = F.avg(x), F.stddev_samp(x)
    log = F.log1p(x) if ret_type == "simple" else x
    down = F.when(x < 0, x)
    return {
        "annualized_return": F.exp(F.sum(log) * a / n) - 1,
        "cumulative_return": F.exp(F.sum(log)) - 1,
        "annualized_vol": sd * math.sqrt(a),
        "winning_percentage": F.sum(F.when(x > 0, 1.0).otherwise(0.0)) / F.count(F.lit(1)),
        "skewness": F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)),
        "value_at_risk": F.percentile(x, F.lit(alpha)),
        "tail_ratio": F.abs(F.percentile(x, F.lit(0.95))) / F.nullif(F.abs(F.percentile(x, F.lit(0.05))), F.lit(0.0)),
        "sharpe_ratio": mean / F.nullif(sd, F.lit(0.0)) * math.sqrt(a),
        "sortino_ratio": mean / F.nullif(F.stddev_samp(down), F.lit(0.0)) * math.sqrt(a),
        "omega_ratio": F.sum(F.when(x > 0, x)) / F.nullif(-F.sum(down), F.lit(0.0)),
        "profit_factor": F.avg(F.when(x > 0, x)) / F.nullif(-F.avg(down), F.lit(0.0)),
    }


KEY = ("annualized_return", "annualized_vol", "sharpe_ratio", "max_drawdown", "calmar_ratio")
PRESETS = {
    "key_metrics": KEY,
    "returns": ("cumulative_return", "annualized_return", "winning_percentage"),
    "risks": ("annualized_vol", "skewness", "kurtosis", "value_at_risk", "expected_shortfall", "max_drawdown", "conditional_drawdown_risk"),
    "ratios": ("sharpe_ratio", "sortino_ratio", "calmar_ratio", "omega_ratio", "profit_factor", "tail_ratio", "stability"),
    "alpha_beta": ("beta", "alpha", "appraisal_ratio"),
}


def performance_table(df: DataFrame, ret_col: str = "ret", metrics: str | tuple = "all", ann_factor: int = 365, ret_type: str = "simple", alpha: float = 0.05, factor_col: str | None = None) -> DataFrame:
    """One row per ticker, a column per metric. Without factor_col the factor is each date's mean return."""
    x, a = F.col(ret_col), float(ann_factor)
    df = drawdown(df, ret_col, "_dd", ret_type)
    df = df.withColumn("_mdd", F.min("_dd").over(frame("ts", "expanding")))
    df = df.withColumns({"_cum": F.log1p("_dd"), "_t": F.row_number().over(Window.partitionBy(TICKER).orderBy(DATE)).cast("double")})
    growth = F.log1p(x) if ret_type == "simple" else x
    df = df.withColumn("_lc", F.sum(growth).over(frame("ts", "expanding")))
    df = df.withColumn("_f", F.col(factor_col) if factor_col else F.avg(x).over(Window.partitionBy(DATE)))
    whole = Window.partitionBy(TICKER)
    df = df.withColumns({"_var": F.percentile(x, F.lit(alpha)).over(whole), "_dq": F.percentile("_mdd", F.lit(alpha)).over(whole)})
    b = F.covar_samp(x, "_f").over(whole) / F.nullif(F.var_samp(F.when(x.isNotNull(), F.col("_f"))).over(whole), F.lit(0.0))
    df = df.withColumn("_b", b).withColumn("_ar", x - F.col("_b") * F.col("_f"))
    made = _columns(ret_col, a, ret_type, alpha) | {
        "max_drawdown": F.min("_dd"),
        "calmar_ratio": (F.exp(F.sum(growth) * a / F.count(x)) - 1) / F.nullif(-F.min("_dd"), F.lit(0.0)),
        "conditional_drawdown_risk": F.avg(F.when(F.col("_mdd") <= F.col("_dq"), F.col("_mdd"))),
        "expected_shortfall": F.avg(F.when(x < F.col("_var"), x)),
        "stability": F.pow(F.corr("_lc", "_t"), F.lit(2.0)),
        "beta": F.max("_b"),
        "alpha": F.pow(1 + F.avg("_ar"), F.lit(a)) - 1,
        "appraisal_ratio": F.avg("_ar") / F.nullif(F.stddev_samp("_ar"), F.lit(0.0)) * math.sqrt(a),
    }
    names = tuple(made) if metrics == "all" else PRESETS[metrics] if isinstance(metrics, str) else metrics
    return df.groupBy(TICKER).agg(*[made[m].alias(m) for m in names])


def rolling_sharpe(df: DataFrame, ret_col: str = "ret", window_size: int = 365, ann_factor: int = 365, output_col: str = "rolling_sharpe") -> DataFrame:
    w = frame("ts", "rolling", window_size)
    x = F.col(ret_col)
    return df.withColumn(output_col, F.when(F.count(x).over(w) >= window_size, safe_div(F.avg(x).over(w), F.stddev_samp(x).over(w)) * math.sqrt(ann_factor)))


def rolling_vol(df: DataFrame, ret_col: str = "ret", window_size: int = 365, ann_factor: int = 365, output_col: str = "rolling_vol") -> DataFrame:
    w = frame("ts", "rolling", window_size)
    return df.withColumn(output_col, F.when(F.count(ret_col).over(w) >= window_size, F.stddev_samp(ret_col).over(w) * math.sqrt(ann_factor)))


rolling = dispatch("rolling metric", {"sharpe_ratio": rolling_sharpe, "annualized_vol": rolling_vol})


def monthly_returns(df: DataFrame, ret_col: str = "ret") -> DataFrame:
    """Ticker and year, a column per month: compounded simple returns."""
    month = df.groupBy(TICKER, F.year(DATE).alias("year"), F.month(DATE).alias("m")).agg((F.exp(F.sum(F.log1p(ret_col))) - 1).alias("r"))
    return month.groupBy(TICKER, "year").pivot("m", list(range(1, 13))).agg(F.first("r")).withColumnsRenamed({str(k): f"m{k:02d}" for k in range(1, 13)})
