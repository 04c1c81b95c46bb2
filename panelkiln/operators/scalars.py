"""Row-wise transforms and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, Window, by_ticker, clean, frame, safe_div
from panelkiln.operators.base import dispatch


def log(df: DataFrame, input_col: str = "close") -> DataFrame:
    c = F.col(input_col)
    return df.withColumn(f"log_{input_col}", clean(F.when(c > 0, F.log(c))))


def square_root(df: DataFrame, input_col: str = "close") -> DataFrame:
    c = F.col(input_col)
    return df.withColumn(f"sqrt_{input_col}", F.when(c >= 0, F.sqrt(c)))


def square(df: DataFrame, input_col: str = "close") -> DataFrame:
    return df.withColumn(f"sq_{input_col}", F.col(input_col) * F.col(input_col))


def power(df: DataFrame, exponent: float = 2, input_col: str = "close") -> DataFrame:
    return df.withColumn(f"power{exponent}_{input_col}", clean(F.pow(F.col(input_col), F.lit(float(exponent)))))


def vwap(df: DataFrame, open_col: str = "open", high_col: str = "high", low_col: str = "low", close_col: str = "close", output_col: str = "vwap") -> DataFrame:
    """The mean of the close and of the mean of open, high and low; volumes play no part."""
    return df.withColumn(output_col, (F.col(close_col) + (F.col(open_col) + F.col(high_col) + F.col(low_col)) / 3) / 2)


def notional_value(df: DataFrame, price_col: str = "close", volume_col: str = "volume", output_col: str = "notional_value", window_size: int = 30, agg_method: str = "mean") -> DataFrame:
    x, w = F.col(price_col) * F.col(volume_col), frame("ts", "rolling", window_size)
    return df.withColumn(output_col, {"mean": F.avg, "sum": F.sum}[agg_method](x).over(w))


def ratio(df: DataFrame, numerator_col: str, denominator_col: str, output_col: str | None = None) -> DataFrame:
    return df.withColumn(output_col or f"{numerator_col}_to_{denominator_col}_ratio", safe_div(F.col(numerator_col), F.col(denominator_col)))


def difference(df: DataFrame, input_col: str = "close", output_col: str = "diff", lags: int = 1) -> DataFrame:
    return df.withColumn(output_col, F.col(input_col) - F.lag(input_col, lags).over(by_ticker()))


def log_return(df: DataFrame, input_col: str = "close", output_col: str = "ret", lags: int = 1) -> DataFrame:
    p = F.when(F.col(input_col) > 0, F.log(input_col))
    return df.withColumn(output_col, p - F.lag(p, lags).over(by_ticker()))


def pct_change(df: DataFrame, input_col: str = "close", output_col: str = "ret", lags: int = 1) -> DataFrame:
    """NULL where the earlier value is 0."""
    return df.withColumn(output_col, safe_div(F.col(input_col), F.lag(input_col, lags).over(by_ticker())) - 1)


def cumulative_return(df: DataFrame, input_col: str = "close", output_col: str = "cum_ret", base_index: int = 0) -> DataFrame:
    """Relative to the row base_index of the ticker; NULL for tickers with fewer rows."""
    whole = by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(output_col, safe_div(F.col(input_col), F.nth_value(input_col, base_index + 1).over(whole)) - 1)


returns = dispatch("returns", {"diff": difference, "log": log_return, "pct": pct_change, "cum": cumulative_return})


def total_return(df: DataFrame, ret_col: str = "ret", financing_col: str = "funding_rate", dividend_col: str | None = None, output_col: str = "total_ret") -> DataFrame:
    out = F.col(ret_col) - F.col(financing_col)
    return df.withColumn(output_col, out + F.col(dividend_col) if dividend_col else out)


def weighted_sum(df: DataFrame, input_col: str = "return", weight_col: str = "weight", output_col: str = "weighted_sum") -> DataFrame:
    """Each date's sum of value times weight, on all of its rows."""
    return df.withColumn(output_col, F.sum(F.col(input_col) * F.col(weight_col)).over(Window.partitionBy(DATE)))


def returns_to_price(df: DataFrame, ret_col: str = "ret", output_col: str = "price", ret_type: str = "simple") -> DataFrame:
    w = frame("ts", "expanding")
    growth = F.log1p(F.col(ret_col)) if ret_type == "simple" else F.col(ret_col)
    return df.withColumn(output_col, F.exp(F.sum(growth).over(w)))


def target_vol(df: DataFrame, ret_col: str = "ret", output_col: str = "vol_adj_ret", ann_vol: float = 0.15, ann_factor: int = 365) -> DataFrame:
    """Scaled to a yearly volatility by each ticker's whole sample."""
    vol = F.stddev_samp(ret_col).over(frame("ts", "fixed")) * float(ann_factor) ** 0.5
    return df.withColumn(output_col, F.col(ret_col) * safe_div(F.lit(ann_vol), vol))


def add_lags(df: DataFrame, input_cols: list[str], lags: int) -> DataFrame:
    return df.withColumns({f"{c}_L{k}": F.lag(c, k).over(by_ticker()) for c in input_cols for k in range(1, lags + 1)})


def densify(df: DataFrame) -> DataFrame:
    """All dates for all tickers. The tickers are joined to the dates by equality of a constant, each date times each ticker being the result itself."""
    dates, tickers = df.select("date").distinct(), df.select("ticker").distinct()
    grid = dates.join(tickers.groupBy().agg(F.collect_set("ticker").alias("_t")), F.lit(True)).select("date", F.explode("_t").alias("ticker"))
    return grid.join(df, ["date", "ticker"], "left")
