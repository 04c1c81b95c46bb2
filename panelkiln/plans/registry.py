"""Queries over the driver tables and their SQL, by name.

Values are rounded to 6 digits on both sides. Each SQL is written from the definition of its operator, not from its plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.operators import factors, metrics, portfolio, regress, scalars, signals, sorts, windows
from panelkiln.operators import attribution, calendar, learn, selection
from panelkiln.plans import strategy
from panelkiln.sources import panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The panels in SQL.
BARS = """b as (select cast(ts as date) as date, event_type as ticker, first(value order by ts, event_id) as open, max(value) as high, min(value) as low,
 last(value order by ts, event_id) as close, cast(count(*) as double) as volume from events group by all)"""
SHIP = """b as (select cast(l_shipdate as date) as date, r_name as ticker, avg(l_extendedprice / l_quantity) as close, max(l_extendedprice / l_quantity) as high,
 min(l_extendedprice / l_quantity) as low, quantile_cont(l_extendedprice / l_quantity, 0.5) as open, sum(l_quantity) as volume
 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all)"""
RETS = "p as (select *, ln(close) - ln(lag(close) over (partition by ticker order by date)) as ret from b)"
MARK = "m as (select *, avg(ret) over (partition by date) as market from p)"


def rolling(n: int) -> str:
    return f"(partition by ticker order by date rows between {n - 1} preceding and current row)"


T = "(partition by ticker order by date)"
E = "(partition by ticker order by date rows between unbounded preceding and current row)"
D = "(partition by date)"


def bars(spark: SparkSession, d: str) -> DataFrame:
    return panels.events_daily(spark, d)


def ship(spark: SparkSession, d: str) -> DataFrame:
    return scalars.log_return(panels.ship_region(spark, d), "close", "ret")


def ship_market(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.market_return(ship(spark, d))


def panel_query(name: str, panel: Callable, build: Callable, column: str, sql: str | None = None, ctes: str = "", of: str = "p") -> None:
    """(date, ticker, value) of an operator's column. `sql` is the value's expression over `of`, or None; `ctes` come before."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return build(panel(spark, d)).select("date", "ticker", F.round(F.col(column).cast("double"), 6).alias("value"))

    QUERIES[name] = run
    if sql is not None:
        base = [BARS if panel is bars else SHIP, RETS, *([MARK] if panel is ship_market else []), *([ctes] if ctes else [])]
        ORACLES[name] = f"with {', '.join(base)} select date, ticker, round(cast({sql} as double), 6) as value from {of}"


def full_query(name: str, run: Callable, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def when_full(x: str, n: int, value: str, w: str | None = None) -> str:
    w = w or rolling(n)
    return f"case when count({x}) over {w} >= {n} then {value} end"


# Row-wise
panel_query("vwap", bars, scalars.vwap, "vwap", "(close + (open + high + low) / 3) / 2")
panel_query("log", bars, scalars.log, "log_close", "case when close > 0 then ln(close) end")
panel_query("sqrt", bars, scalars.square_root, "sqrt_close", "case when close >= 0 then sqrt(close) end")
panel_query("square", bars, lambda p: scalars.square(p, "volume"), "sq_volume", "volume * volume")
panel_query("power", bars, lambda p: scalars.power(p, 1.5, "volume"), "`power1.5_volume`", "pow(volume, 1.5)")
panel_query("notional_value", bars, lambda p: scalars.notional_value(p, window_size=5), "notional_value", f"avg(close * volume) over {rolling(5)}")
panel_query("ratio", bars, lambda p: scalars.ratio(p, "close", "volume"), "close_to_volume_ratio", "close / nullif(volume, 0)")
panel_query("difference", bars, lambda p: scalars.difference(p, lags=2), "diff", f"close - lag(close, 2) over {T}")
panel_query("log_return", ship, lambda p: p, "ret", "ret")
panel_query("pct_change", ship, lambda p: scalars.pct_change(p, "close", "x"), "x", f"close / nullif(lag(close) over {T}, 0) - 1")
panel_query("cumulative_return", ship, lambda p: scalars.cumulative_return(p, base_index=2), "cum_ret", "close / nullif(nth_value(close, 3) over (partition by ticker order by date rows between unbounded preceding and unbounded following), 0) - 1")
panel_query("total_return", ship, lambda p: scalars.total_return(p.withColumn("funding_rate", F.col("volume") * 1e-6)), "total_ret", "ret - volume * 1e-6::double")
panel_query("weighted_sum", ship, lambda p: scalars.weighted_sum(p, "ret", "volume"), "weighted_sum", f"sum(ret * volume) over {D}")
panel_query("returns_to_price", ship, lambda p: scalars.returns_to_price(p, ret_type="log"), "price", f"exp(sum(ret) over {E})")
panel_query("target_vol", ship, scalars.target_vol, "vol_adj_ret", "ret * 0.15::double / nullif(stddev_samp(ret) over (partition by ticker) * sqrt(365), 0)")
panel_query("add_lags", ship, lambda p: scalars.add_lags(p, ["ret"], 3), "ret_L3", f"lag(ret, 3) over {T}")

# Windows
panel_query("rolling_mean", ship, lambda p: windows.smooth(p, window_size=10), "close_smooth", when_full("close", 10, f"avg(close) over {rolling(10)}"))
panel_query("rolling_median", ship, lambda p: windows.smooth(p, window_size=10, central_tendency="median"), "close_smooth", when_full("close", 10, f"quantile_cont(close, 0.5) over {rolling(10)}"))
panel_query("expanding_mean_lagged", ship, lambda p: windows.smooth(p, window_type="expanding", lags=1), "close_smooth", f"lag(v) over {T}", f"v as (select *, avg(close) over {E} as v from p)", "v")
panel_query("rolling_std", ship, lambda p: windows.std(p, window_size=20), "std", when_full("ret", 2, f"stddev_samp(ret) over {rolling(20)}", rolling(20)))
panel_query("cs_std", ship, lambda p: windows.std(p, axis="cs"), "std", when_full("ret", 2, f"stddev_samp(ret) over {D}", D))
panel_query("expanding_variance", ship, lambda p: windows.variance(p, min_periods=2), "var", when_full("ret", 2, f"var_samp(ret) over {E}", E))
panel_query("rolling_quantile", ship, lambda p: windows.windowed_quantile(p, q=0.9, window_type="rolling", window_size=15), "quantile", f"quantile_cont(ret, 0.9) over {rolling(15)}")
panel_query("rolling_iqr", ship, lambda p: windows.iqr(p, window_type="rolling", window_size=15), "iqr", f"(quantile_cont(ret, 0.75) over {rolling(15)} - quantile_cont(ret, 0.25) over {rolling(15)}) / 1.349::double")
panel_query("rolling_mad", ship, lambda p: windows.mad(p, window_size=15), "mad", f"quantile_cont(o, 0.5) over {rolling(15)} / 0.6745::double", f"o as (select *, abs(ret - quantile_cont(ret, 0.5) over {rolling(15)}) as o from p)", "o")
panel_query("expanding_range", ship, windows.min_max, "range", f"max(ret) over {E} - min(ret) over {E}")
TR = f"t as (select *, greatest(high - low, abs(high - lag(close) over {T}), abs(low - lag(close) over {T})) as tr from p)"
panel_query("atr", ship, lambda p: windows.atr(p, window_type="rolling", window_size=14), "atr", f"avg(tr) over {rolling(14)}", TR, "t")
panel_query("rolling_skew", ship, lambda p: windows.skewness(p, window_size=20, min_periods=20), "skew", when_full("ret", 20, f"skewness(ret) over {rolling(20)}"))
panel_query("rolling_kurt", ship, lambda p: windows.kurtosis(p, window_size=20, min_periods=20), "kurt", when_full("ret", 20, f"kurtosis(ret) over {rolling(20)}"))
panel_query("center", ship, lambda p: windows.center(p, "ret", method="median", window_type="rolling", window_size=10), "center", f"ret - quantile_cont(ret, 0.5) over {rolling(10)}")
panel_query("zscore", ship, lambda p: windows.zscore(p, "ret", min_periods=5, winsorize=3), "zscore", when_full("ret", 5, f"greatest(least((ret - avg(ret) over {E}) / nullif(stddev_samp(ret) over {E}, 0), 3), -3) + 0 * ret", E))
panel_query("cs_zscore", ship, lambda p: windows.zscore(p, "ret", axis="cs", min_periods=3), "zscore", when_full("ret", 3, f"(ret - avg(ret) over {D}) / nullif(stddev_samp(ret) over {D}, 0)", D))
panel_query("robust_zscore", ship, lambda p: windows.robust_zscore(p, "ret", window_type="rolling", window_size=20, min_periods=5), "zscore", when_full("ret", 5, f"(ret - quantile_cont(ret, 0.5) over {rolling(20)}) / nullif((quantile_cont(ret, 0.75) over {rolling(20)} - quantile_cont(ret, 0.25) over {rolling(20)}) / 1.349::double, 0)", rolling(20)))
OFF = f"o as (select *, quantile_cont(ret, 0.5) over {rolling(20)} as med, abs(ret - quantile_cont(ret, 0.5) over {rolling(20)}) as o from p)"
panel_query("mod_zscore", ship, lambda p: windows.mod_zscore(p, "ret", window_type="rolling", window_size=20, min_periods=1), "zscore", f"(ret - med) / nullif(quantile_cont(o, 0.5) over {rolling(20)} / 0.6745::double, 0)", OFF, "o")
RANK = "k as (select *, case when ret is not null then rank() over (partition by date order by ret nulls last) + (count(ret) over (partition by date, ret) - 1) / 2.0::double end as rk, count(ret) over (partition by date) as cn from p)"
panel_query("cs_percentile", ship, lambda p: windows.percentile(p, "ret", axis="cs"), "percentile", "rk / cn", RANK, "k")
panel_query("cs_rank", ship, lambda p: windows.rank(p, "ret", axis="cs"), "rank", "case when cn >= 2 then rk end", RANK, "k")
TSRANK = "k as (select a.date, a.ticker, count(case when c.close < a.close then 1 end) + (count(case when c.close = a.close then 1 end) + 1) / 2.0::double as rk, count(*) as n from p a join p c on a.ticker = c.ticker and c.date <= a.date group by all)"
panel_query("ts_rank", bars, lambda p: windows.rank(p, "close"), "rank", "case when n >= 2 then rk end", TSRANK, "k")
panel_query("min_max_scaler", ship, lambda p: windows.min_max_scaler(p, window_type="rolling", window_size=30), "min_max_scaled", f"(close - min(close) over {rolling(30)}) / nullif(max(close) over {rolling(30)} - min(close) over {rolling(30)}, 0)")
panel_query("atr_scaler", ship, lambda p: windows.atr_scaler(p, window_type="rolling", window_size=14), "atr_scaled", f"(d - quantile_cont(d, 0.5) over {rolling(14)}) / nullif(avg(tr) over {rolling(14)}, 0)", TR + f", d as (select *, close - lag(close) over {T} as d from t)", "d")
panel_query("cs_quantize", ship, lambda p: windows.quantize(p, "ret", axis="cs", bins=3), "quantile", "case when cn >= 2 then ceil(round(rk / cn * 3, 9)) end", RANK, "k")
panel_query("discretize_uniform", ship, lambda p: windows.discretize(p, "ret", axis="cs", method="uniform", bins=4, min_periods=2), "discretized", f"case when ret is not null and count(ret) over {D} >= 2 then coalesce(least(floor((ret - min(ret) over {D}) * 4 / nullif(max(ret) over {D} - min(ret) over {D}, 0)), 3) + 1, 1) end")
panel_query("discretize_quantile", ship, lambda p: windows.discretize(p, "ret", bins=4, window_type="rolling", window_size=20, min_periods=5), "discretized", f"case when ret is not null and count(ret) over {rolling(20)} >= 5 then 1 " + "".join(f"+ case when ret >= quantile_cont(ret, {k / 4}) over {rolling(20)} then 1 else 0 end " for k in (1, 2, 3)) + "end")
panel_query("discretize_kmeans", ship, lambda p: windows.discretize(p, "ret", axis="cs", method="kmeans", bins=2), "discretized")
panel_query("power_transform", bars, lambda p: windows.power_transform(p, "close", method="yeo-johnson", min_periods=5), "power_zscore")

# Exponential weights: running sums of x q^-i over those of q^-i.
Q10 = 1 - 2 / 11


def ewm_sql(x: str, q: float) -> str:
    return f"sum({x} * pow({q!r}::double, -i)) over {E} / nullif(sum(case when {x} is not null then pow({q!r}::double, -i) end) over {E}, 0)"


NUM = f"i as (select *, row_number() over {T} as i, sign(close - lag(close) over {T}) as s from p)"
panel_query("ewm_mean", bars, lambda p: windows.smooth(p, window_type="ewm", window_size=10), "close_smooth", ewm_sql("close", Q10), NUM, "i")
panel_query("ewma_trend", bars, lambda p: factors.ewma(p, window_size=10), "EWMA_10", ewm_sql("ret", Q10), NUM, "i")
panel_query("divergence", bars, lambda p: factors.divergence(p, window_size=10), "Divergence_10", ewm_sql("s", Q10), NUM, "i")
panel_query("ewm_std", ship, lambda p: windows.std(p, window_type="ewm", window_size=20), "std")

# Regressions
panel_query("beta", ship_market, lambda p: regress.betas(p, "ret", "market", window_size=30), "beta", "v", f"c as (select *, case when count(*) over {rolling(30)} >= 30 then regr_slope(ret, market) over {rolling(30)} end as v from m where ret is not null), z as (select m.date, m.ticker, c.v from m left join c using (date, ticker))", "z")
panel_query("residual", ship_market, lambda p: regress.residuals(p, "ret", "market", window_size=30), "residual", "v", f"c as (select *, case when count(*) over {rolling(30)} >= 30 then ret - (regr_intercept(ret, market) over {rolling(30)} + regr_slope(ret, market) over {rolling(30)} * market) end as v from m where ret is not null), z as (select m.date, m.ticker, c.v from m left join c using (date, ticker))", "z")
IDIO = f"c as (select *, case when count(*) over {rolling(30)} >= 30 then ret - regr_slope(ret, market) over {rolling(30)} * ret end as v from m where ret is not null), z as (select m.date, m.ticker, c.v from m left join c using (date, ticker))"
panel_query("idiosyncratic_returns", ship_market, lambda p: regress.idiosyncratic_returns(p, own_return=False), "idio_ret", "v", f"c as (select *, case when count(*) over {rolling(30)} >= 30 then ret - regr_slope(ret, market) over {rolling(30)} * market end as v from m where ret is not null), z as (select m.date, m.ticker, c.v from m left join c using (date, ticker))", "z")
panel_query("multi_ols", ship_market, lambda p: regress.rolling_multi_ols(p, "ret", ["market", "volume"], "b", window_size=60), "b_resid")
full_query("ticker_ols", lambda s, d: regress.ticker_ols(ship_market(s, d), "ret", ["market"]).select("ticker", "term", F.round("coef", 6).alias("coef"), F.round("r2", 6).alias("r2"), "n"),
           f"with {SHIP}, {RETS}, {MARK}, r as (select ticker, regr_slope(ret, market) as b, regr_intercept(ret, market) as a, regr_r2(ret, market) as r2, regr_count(ret, market) as n from m group by ticker) "
           "select ticker, 'const' as term, round(a, 6) as coef, round(r2, 6) as r2, cast(n as bigint) as n from r union all select ticker, 'market', round(b, 6), round(r2, 6), cast(n as bigint) from r")  # fmt: skip
full_query("adf_test", lambda s, d: regress.adf_test(ship(s, d), "ret"))
full_query("granger", lambda s, d: regress.granger(ship_market(s, d), "ret", "market", 2))

# Trend
panel_query("price_momentum", ship, factors.price_momentum, "PriceMomentum_30", f"(ln(close) - lag(ln(close), 30) over {T}) / sqrt(30)")
panel_query("time_trend", ship, factors.time_trend, "TimeTrend_30", when_full("close", 30, f"regr_slope(close, i) over {rolling(30)}"), f"i as (select *, cast(row_number() over {T} as double) as i from p)", "i")
panel_query("alpha_momentum", ship_market, factors.alpha_momentum, "AlphaMomentum_30", "v", f"c as (select *, case when count(*) over {rolling(30)} >= 30 then regr_intercept(ret, market) over {rolling(30)} end as v from m where ret is not null), z as (select m.date, m.ticker, c.v from m left join c using (date, ticker))", "z")
panel_query("price_acceleration", ship, factors.price_acceleration, "PriceAcceleration_30")
UPDOWN = f"u as (select *, {when_full('ret', 14, f'avg(greatest(ret, 0)) over {rolling(14)}')} as up, {when_full('ret', 14, f'avg(greatest(-ret, 0)) over {rolling(14)}')} as down from p)"
panel_query("rsi", ship, lambda p: factors.rsi(p, window_size=14), "RSI_14", "coalesce(100 - 100 / (1 + up / nullif(down, 0)), case when up > 0 then 100 end) / 50 - 1", UPDOWN, "u")
STO = f"k as (select *, (close - min(low) over {rolling(30)}) / nullif(max(high) over {rolling(30)} - min(low) over {rolling(30)}, 0) as k from p)"
panel_query("stochastic", ship, factors.stochastic, "Stochastic_30", when_full("k", 6, f"2 * avg(greatest(least(k, 1), 0)) over {rolling(6)} - 1"), STO, "k")
panel_query("intensity", ship, factors.intensity, "Intensity_30")
panel_query("mw_difference", ship, factors.mw_difference, "MWDifference_30", f"{when_full('close', 30, f'avg(close) over {rolling(6)} - avg(close) over {rolling(30)}')}")
panel_query("triple_ewma_difference", ship, factors.triple_ewma_difference, "TripleEWMADifference")
panel_query("energy", ship, factors.energy, "Energy_30", f"(ln(close) - lag(ln(close), 30) over {T}) * stddev_samp(ret) over {rolling(30)}")
panel_query("snr", ship, factors.snr, "SNR_30", f"(close - lag(close, 30) over {T}) / nullif({when_full('d', 30, f'sum(d) over {rolling(30)}')}, 0)", f"d as (select *, abs(close - lag(close) over {T}) as d from p)", "d")
panel_query("adx", ship, factors.adx, "ADX_30")
panel_query("breakout", ship, factors.breakout, "Breakout_30", when_full("close", 30, f"(close - min(close) over {rolling(30)}) / nullif(max(close) over {rolling(30)} - min(close) over {rolling(30)}, 0) * 2 - 1"))
panel_query("idiosyncratic_ewma", ship_market, factors.idiosyncratic_ewma, "IdiosyncraticEWMA_30")

# Volatility
A = math.sqrt(365)
panel_query("vol_std", ship, factors.vol_std, "STD_30", when_full("ret", 2, f"stddev_samp(ret) over {rolling(30)} * {A!r}::double", rolling(30)))
panel_query("vol_iqr", ship, factors.vol_iqr, "IQR_30", f"(quantile_cont(ret, 0.75) over {rolling(30)} - quantile_cont(ret, 0.25) over {rolling(30)}) / 1.349::double * {A!r}::double")
panel_query("vol_mad", ship, factors.vol_mad, "MAD_30", f"quantile_cont(o, 0.5) over {rolling(30)} / 0.6745::double * {A!r}::double", f"o as (select *, abs(ret - quantile_cont(ret, 0.5) over {rolling(30)}) as o from p)", "o")
panel_query("vol_atr", ship, factors.vol_atr, "ATR_30", f"avg(tr) over {rolling(30)} * {A!r}::double", TR, "t")
GK = f"avg(pow(ln(high / low), 2)) over {rolling(30)} / 2 - (2 * ln(2) - 1) * avg(pow(ln(close / open), 2)) over {rolling(30)}"
panel_query("garman_klass", ship, factors.garman_klass, "GarmanKlass_30", f"sqrt(g) * {A!r}::double", f"g as (select *, case when {GK} >= 0 then {GK} end as g from p)", "g")
panel_query("parkinson", ship, factors.parkinson, "Parkinson_30", f"sqrt(avg(pow(ln(high / low), 2)) over {rolling(30)}) / (4 * ln(2)) * {A!r}::double")
RS = f"avg(ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)) over {rolling(30)}"
panel_query("rogers_satchell", ship, factors.rogers_satchell, "RogersSatchell_30", f"sqrt(case when {RS} >= 0 then {RS} end) * {A!r}::double")
panel_query("ivol", ship_market, factors.ivol, "IVol_30", when_full("v", 2, f"stddev_samp(v) over {rolling(30)} * {A!r}::double", rolling(30)), IDIO, "z")

# Carry, value, size, low risk, reversal
panel_query("carry", ship, lambda p: factors.carry(p, "close", fwd_col="open"), "carry", f"-(open / close - 1) * {A!r}::double", "q as (select * from p where close <> 0 and open <> 0)", "q")
panel_query("carry_vol", ship, lambda p: factors.carry_vol(p, spot_col="close", fwd_col="open", scaling_window=60), "carry_vol", f"-(open / close - 1) / nullif(case when count(ret) over {rolling(60)} >= 2 then stddev_samp(ret) over {rolling(60)} end, 0) * {A!r}::double")
panel_query("value_ratio", ship, lambda p: factors.value_ratio(p, "volume", "close", "metcalfe_gen"), "value_ratio", "-pow(volume, 1.5) / nullif(close, 0)")
panel_query("value_residual", ship, lambda p: factors.value_residual(p, "volume", "close", window_size=60), "value_residual", when_full("close", 60, f"-(close - (regr_intercept(close, volume) over {rolling(60)} + regr_slope(close, volume) over {rolling(60)} * volume))"))
panel_query("size", ship, lambda p: factors.size(p, "volume"), "size", "-volume")
panel_query("low_beta", ship_market, factors.low_beta, "Beta_30", "-v", f"c as (select *, case when count(*) over {rolling(30)} >= 30 then regr_slope(ret, market) over {rolling(30)} end as v from m where ret is not null), z as (select m.date, m.ticker, c.v from m left join c using (date, ticker))", "z")
panel_query("max_dd", ship, lambda p: factors.max_dd(p, ret_type="log"), "MaxDD_30", f"min(d) over {rolling(30)}", f"v as (select *, case when ret is not null then exp(sum(ret) over {E}) end as v from p), w as (select *, v / max(v) over {rolling(30)} - 1 as d from v)", "w")
panel_query("mw_deviation", ship, factors.mw_deviation, "MWDeviation_30", when_full("close", 30, f"avg(close) over {rolling(30)} - close"))
panel_query("linear_deviation", ship, factors.linear_deviation, "LinearDeviation_30", when_full("close", 30, f"regr_intercept(close, i) over {rolling(30)} + regr_slope(close, i) over {rolling(30)} * i - close"), f"i as (select *, cast(row_number() over {T} as double) as i from p)", "i")
panel_query("idiosyncratic_deviation", ship_market, factors.idiosyncratic_deviation, "IdiosyncraticDeviation_30", "-v", f"u as (select date, ticker, sum(ret) over {T} as y, sum(market) over {T} as x, ret, market from m), c as (select *, case when count(*) over {rolling(30)} >= 30 then y - (regr_intercept(y, x) over {rolling(30)} + regr_slope(y, x) over {rolling(30)} * x) end as v from u where ret is not null and market is not null), z as (select m.date, m.ticker, c.v from m left join c using (date, ticker))", "z")
panel_query("rsi_detrended", ship, factors.rsi_detrended, "RSIDetrended_30")

# Liquidity and skew
panel_query("amihud", ship, lambda p: factors.amihud(p, scale=True), "amihud", "abs(ret) / nullif(close * volume, 0) * 1e6")
panel_query("traded_value", ship, factors.traded_value, "notional_value", "nullif(close * volume, 0)")
HL = f"""g as (select *, lag(close) over {T} as c0, case when c0 < low then low - c0 when c0 > high then high - c0 when c0 is not null then 0 end as gap from p),
 h as (select *, (high - gap) / nullif(low - gap, 0) as own, lag(high) over {T} as h1, lag(low) over {T} as l1 from g),
 i as (select *, case when own > 0 then pow(ln(own), 2) end as b1, case when h1 is not null then pow(ln(greatest(high, h1) / least(low, l1)), 2) end as g2 from h),
 j as (select *, (sqrt(2 * (b1 + lag(b1) over {T})) - sqrt(b1 + lag(b1) over {T})) / (3 - 2 * sqrt(2)) - sqrt(g2 / (3 - 2 * sqrt(2))) as a from i)"""
panel_query("high_low_spread", ship, factors.high_low_spread, "hl_spread", "case when a is not null then 2 * (exp(greatest(a, 0)) - 1) / (exp(greatest(a, 0)) + 1) end", HL, "j")
panel_query("edge", ship, factors.edge, "edge_spread")
# Each window's bars side by side: first its means, then both conditions bar by bar.
ORACLES["edge"] = f"""with {SHIP},
 t as (select date, ticker, row_number() over {T} as i, ln(open) as o, ln(high) as h, ln(low) as l, ln(close) as c, (ln(high) + ln(low)) / 2 as m from b),
 q as (select *, lag(h) over {T} as hb, lag(l) over {T} as lb, lag(c) over {T} as cb, lag(m) over {T} as mb from t),
 r as (select ticker, i, cast(h <> l or l <> cb as double) as traded, cast(o <> h as double) + cast(o <> l as double) as off_open, cast(cb <> hb as double) + cast(cb <> lb as double) as off_close,
  m - o as a, o - mb as before_a, m - cb as d, cb - mb as before_d, o - cb as n from q where i > 1),
 w as (select t.ticker, t.i as k, r.* exclude (ticker, i) from t join r on r.ticker = t.ticker and r.i between t.i - 28 and t.i where t.i >= 30),
 g as (select ticker, k, avg(traded) as part, avg(traded * off_open) as po, avg(traded * off_close) as pc, avg(a) as ma, avg(d) as md, avg(n) as mn from w group by all having sum(traded) >= 2),
 x as (select ticker, k, -4 / po * (a - ma / part * traded) * before_a - 4 / pc * (d - md / part * traded) * before_d as x1,
  -4 / po * (a - ma / part * traded) * n - 4 / pc * (n - mn / part * traded) * before_d as x2 from w join g using (ticker, k) where po > 0 and pc > 0),
 e as (select ticker, k, avg(x1) as e1, avg(x2) as e2, avg(x1 * x1) - avg(x1) * avg(x1) as v1, avg(x2 * x2) - avg(x2) * avg(x2) as v2 from x group by all)
 select t.date, t.ticker, round(sqrt(abs(case when v1 + v2 > 0 then (v2 * e1 + v1 * e2) / (v1 + v2) else (e1 + e2) / 2 end)), 6) as value
 from t left join e on e.ticker = t.ticker and e.k = t.i"""
panel_query("skew", ship, factors.skew, "Skew_30", when_full("ret", 30, f"skewness(ret) over {rolling(30)}"))
panel_query("max_return", ship, factors.max_return, "Max_30", when_full("ret", 30, f"max(ret) over {rolling(30)}"))
panel_query("min_return", ship, factors.min_return, "Min_30", when_full("ret", 30, f"min(ret) over {rolling(30)}"))
TOP = f"l as (select *, list_sort(list(ret) over {rolling(30)}) as l, count(ret) over {rolling(30)} as c from p)"
panel_query("max_min", ship, lambda p: factors.max_min(p, n_top=3), "MaxMin_30", "case when c >= 30 then list_avg(list_reverse_sort(list_filter(l, lambda x: x is not null))[1:3]) - abs(list_avg(list_filter(l, lambda x: x is not null)[1:3])) end", TOP, "l")
panel_query("iskew", ship_market, factors.iskew, "ISkew_30", when_full("v", 30, f"skewness(v) over {rolling(30)}"), IDIO, "z")

# Signals
Z = "z as (select *, (ret - avg(ret) over (partition by date)) / nullif(stddev_samp(ret) over (partition by date), 0) as z, count(ret) over (partition by date) as cn from p), y as (select *, case when cn >= 3 then z end as s from z)"


def scored(p: DataFrame) -> DataFrame:
    return windows.zscore(p, "ret", "score", axis="cs", min_periods=3)


panel_query("score_signal_logistic", ship, lambda p: signals.score_signal(scored(p), "score", "logistic"), "signal", "2 / (1 + exp(-s)) - 1", Z, "y")
panel_query("score_signal_tanh", ship, lambda p: signals.score_signal(scored(p), "score", "tanh", lags=1), "signal", f"lag((exp(2 * s) - 1) / (exp(2 * s) + 1)) over {T}", Z, "y")
panel_query("score_signal_norm", ship, lambda p: signals.score_signal(scored(p), "score", "norm"), "signal")
panel_query("score_signal_adj_norm", ship, lambda p: signals.score_signal(scored(p), "score", "adj_norm", direction="long", leverage=2), "signal", "case when s is not null then greatest(s * exp(-s * s / 4) / 0.89::double, 0) * 2 end", Z, "y")
panel_query("buy_hold", ship, signals.buy_hold, "signal", "sign(abs(ret))")
panel_query("sign_signal", ship, lambda p: signals.sign_signal(scored(p), "score"), "signal", "sign(s)", Z, "y")
panel_query("discrete_zscore", ship, lambda p: signals.discrete_zscore(scored(p), long_z_score=1, short_z_score=-1), "signal", "case when s >= 1 then 1 when s <= -1 then -1 when s is not null then 0 end", Z, "y")
panel_query("quantile_signal", ship, lambda p: signals.quantile_signal(windows.quantize(p, "ret", axis="cs", bins=3), axis="cs", bins=3), "signal", f"case when count(q) over {D} >= 3 then (q - min(q) over {D}) / nullif(max(q) over {D} - min(q) over {D}, 0) * 2 - 1 end", RANK + ", q as (select *, case when cn >= 2 then ceil(round(rk / cn * 3, 9)) end as q from k)", "q")
panel_query("rank_signal", ship, lambda p: signals.rank_signal(windows.rank(p, "ret", axis="cs"), axis="cs"), "signal", f"(q - min(q) over {D}) / nullif(max(q) over {D} - min(q) over {D}, 0) * 2 - 1", RANK + ", q as (select *, case when cn >= 2 then rk end as q from k)", "q")
panel_query("discrete_rank", ship, lambda p: signals.discrete_rank(windows.rank(p, "ret", axis="cs"), n_assets=1), "signal", f"case when count(q) over {D} > 2 then case when q >= max(q) over {D} - 1 then 1 when q <= min(q) over {D} + 1 then -1 when q is not null then 0 end end", RANK + ", q as (select *, case when cn >= 2 then rk end as q from k)", "q")
panel_query("discrete_quantile", ship, lambda p: signals.discrete_quantile(windows.quantize(p, "ret", axis="cs", bins=3)), "signal", "case when q = max(q) over () then 1 when q = min(q) over () then -1 when q is not null then 0 end", RANK + ", q as (select *, case when cn >= 2 then ceil(round(rk / cn * 3, 9)) end as q from k)", "q")
panel_query("combine_median", ship, lambda p: signals.combine(p, ["open", "high", "low", "close"], "median"), "combined", "list_median([open, high, low, close])")
panel_query("combine_mean", ship, lambda p: signals.combine(p, ["ret", "close"]), "combined", "list_avg([ret, close])")
panel_query("threshold", ship, lambda p: signals.threshold(scored(p), "score", 0.6), "signal", "case when abs(s) >= 0.6 then sign(s) when s is not null then 0 end", Z, "y")
panel_query("rebalance_monthly", ship, lambda p: signals.rebalance(p, "month_start", "ret", "held"), "held", f"last_value(h ignore nulls) over {E}", "h as (select *, case when day(date) = 1 then ret end as h from p)", "h")
panel_query("signal_returns", ship, lambda p: signals.signal_returns(signals.sign_signal(scored(p), "score"), t_cost=0.001), "net", f"h * ret - abs(h - coalesce(lag(h) over {T}, 0)) * 0.001::double", Z + f", h as (select *, lag(sign(s)) over {T} as h from y)", "h")
panel_query("signal_chain", ship, lambda p: signals.signal_chain(p, ["ret", "volume"], axis="cs", mapping="tanh"), "signal")
panel_query("target", ship, lambda p: signals.target(p, lead=5), "target", f"ln(lead(close, 5) over {T}) - ln(close)")
full_query("signal_dispersion", lambda s, d: signals.signal_dispersion(ship(s, d), "ret", "range").select("date", F.round("dispersion", 6).alias("dispersion")),
           f"with {SHIP}, {RETS} select date, round(max(ret) - min(ret), 6) as dispersion from p where ret is not null group by date")
full_query("factor_correlation", lambda s, d: signals.correlation(ship(s, d), ["open", "close", "volume"], "pearson").select("a", "b", F.round("correlation", 6).alias("correlation")),
           f"with {SHIP} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as correlation from b" for a in ("open", "close", "volume") for b in ("open", "close", "volume")))

# Portfolios
panel_query("liquidity_filter", ship, lambda p: portfolio.liquidity_filter(p, filter_col="ret", top=2), "ret", "case when r <= 2 then ret end", f"n as (select *, avg(close * volume) over {rolling(30)} as nv from p), r as (select *, row_number() over (partition by date order by nv desc nulls last, ticker) as r from n)", "r")
panel_query("market_return", ship_market, lambda p: p, "market", "market", of="m")
panel_query("weights", ship, lambda p: portfolio.weights(p, "ret"), "weight", f"ret / case when sum(abs(ret)) over {D} = 0 then 1e-9::double else sum(abs(ret)) over {D} end")
panel_query("equal_weight", ship, lambda p: portfolio.equal_weight(signals.sign_signal(p, "ret")), "weight", f"sign(ret) / nullif(count(case when sign(ret) <> 0 then 1 end) over {D}, 0)")
panel_query("inverse_volatility", ship, portfolio.inverse_risk, "weight", f"i / sum(i) over {D}", f"i as (select *, {when_full('ret', 30, f'1 / nullif(stddev_samp(ret) over {rolling(30)}, 0)')} as i from p)", "i")
panel_query("inverse_variance", ship, lambda p: portfolio.inverse_risk(p, power=2), "weight", f"i / sum(i) over {D}", f"i as (select *, {when_full('ret', 30, f'1 / nullif(pow(stddev_samp(ret) over {rolling(30)}, 2), 0)')} as i from p)", "i")
panel_query("commission", ship, lambda p: portfolio.commission(portfolio.weights(p, "ret")), "cost", f"abs(coalesce(w, 0) - coalesce(lag(w) over {T}, 0)) * 0.001::double", f"w as (select *, ret / sum(abs(ret)) over {D} as w from p)", "w")
full_query("portfolio_returns", lambda s, d: portfolio.portfolio_returns(portfolio.inverse_risk(ship(s, d)), rate=0.001).select("date", *[F.round(c, 6).alias(c) for c in ("gross", "cost", "net")]),
           f"with {SHIP}, {RETS}, i as (select *, {when_full('ret', 30, f'1 / nullif(stddev_samp(ret) over {rolling(30)}, 0)')} as i from p), w as (select *, i / sum(i) over {D} as w from i), h as (select *, lag(w) over {T} as h from w), "
           f"c as (select *, abs(coalesce(h, 0) - coalesce(lag(h) over {T}, 0)) * 0.001::double as c from h) select date, round(sum(h * ret), 6) as gross, round(sum(c), 6) as cost, round(coalesce(sum(h * ret), 0) - sum(c), 6) as net from c group by date")  # fmt: skip
#: Each window's variance by name, where it has half of the window's returns and they vary; a missing return counts as none.
WINDOWS = f"""with {SHIP}, {RETS}, d as (select date, row_number() over (order by date) - 1 as n from (select distinct date from p)),
 v as (select e.date, ticker, sum(coalesce(ret, 0) * coalesce(ret, 0)) - sum(coalesce(ret, 0)) * sum(coalesce(ret, 0)) / 60 as v
 from d e join d on d.n between e.n - 59 and e.n join p on p.date = d.date where e.n >= 59 group by e.date, ticker having count(ret) >= 30)"""
_CLOSED = {"equal_weight": "1", "inverse_variance": "1 / v", "inverse_volatility": "1 / sqrt(v)"}
for _method in portfolio.OPTIMIZERS:
    full_query(f"optimize_{_method}", lambda s, d, m=_method: portfolio.windowed_weights(ship(s, d), method=m, window_size=60, every=1).select("date", "ticker", F.round("weight", 6).alias("weight")),
               f"{WINDOWS} select date, ticker, round({_CLOSED[_method]} / sum({_CLOSED[_method]}) over (partition by date), 6) as weight from v where v > 1e-18" if _method in _CLOSED else None)
for _estimator in ("ledoit_wolf", "oas", "denoised_covariance", "exponential_covariance", "graphical_lasso"):
    full_query(f"min_vol_{_estimator}", lambda s, d, e=_estimator: portfolio.windowed_weights(ship(s, d), method="min_vol", window_size=60, every=1, estimator=e).select("date", "ticker", F.round("weight", 6).alias("weight")))
full_query("backtest", lambda s, d: portfolio.backtest((p := ship(s, d)), portfolio.windowed_weights(p, method="risk_parity", window_size=60, every=1)).select("date", F.round("value", 6).alias("value"), F.round("cost", 6).alias("cost")))

# Performance
panel_query("drawdown", ship, lambda p: metrics.drawdown(p, ret_type="log"), "drawdown", f"v / max(v) over {E} - 1", f"v as (select *, exp(sum(ret) over {E}) as v from p)", "v")
panel_query("rolling_sharpe", ship, lambda p: metrics.rolling_sharpe(p, window_size=60), "rolling_sharpe", when_full("ret", 60, f"avg(ret) over {rolling(60)} / nullif(stddev_samp(ret) over {rolling(60)}, 0) * {A!r}::double"))
panel_query("rolling_vol", ship, lambda p: metrics.rolling_vol(p, window_size=60), "rolling_vol", when_full("ret", 60, f"stddev_samp(ret) over {rolling(60)} * {A!r}::double"))
_SHOWN = ("annualized_vol", "sharpe_ratio", "sortino_ratio", "omega_ratio", "profit_factor", "max_drawdown", "value_at_risk", "expected_shortfall", "skewness", "kurtosis", "winning_percentage", "beta")
full_query("performance_table", lambda s, d: metrics.performance_table(ship(s, d), ret_type="log", metrics=_SHOWN).select("ticker", *[F.round(m, 6).alias(m) for m in _SHOWN]),
           f"with {SHIP}, {RETS}, v as (select *, exp(sum(ret) over {E}) as v, avg(ret) over {D} as f from p), dd as (select *, v / max(v) over {E} - 1 as dd, quantile_cont(ret, 0.05) over (partition by ticker) as q from v) "
           f"select ticker, round(stddev_samp(ret) * {A!r}::double, 6) as annualized_vol, round(avg(ret) / stddev_samp(ret) * {A!r}::double, 6) as sharpe_ratio, round(avg(ret) / stddev_samp(case when ret < 0 then ret end) * {A!r}::double, 6) as sortino_ratio, "
           "round(sum(case when ret > 0 then ret end) / -sum(case when ret < 0 then ret end), 6) as omega_ratio, round(avg(case when ret > 0 then ret end) / -avg(case when ret < 0 then ret end), 6) as profit_factor, "
           "round(min(dd), 6) as max_drawdown, round(max(q), 6) as value_at_risk, round(avg(case when ret < q then ret end), 6) as expected_shortfall, round(skewness(ret), 6) as skewness, round(kurtosis(ret), 6) as kurtosis, "
           "round(sum(case when ret > 0 then 1 else 0 end)::double / count(*), 6) as winning_percentage, round(regr_slope(ret, f), 6) as beta from dd group by ticker")  # fmt: skip
full_query("monthly_returns", lambda s, d: metrics.monthly_returns(scalars.pct_change(panels.ship_region(s, d))).select("ticker", "year", *[F.round(f"m{k:02d}", 6).alias(f"m{k:02d}") for k in range(1, 13)]),
           f"with {SHIP}, r as (select *, close / lag(close) over {T} as up from b) select ticker, year(date) as year, " + ", ".join(f"round(exp(sum(ln(up)) filter (month(date) = {k})) - 1, 6) as m{k:02d}" for k in range(1, 13)) + " from r group by ticker, year(date)")

# Sorts and tests
full_query("portfolio_sort", lambda s, d: sorts.portfolio_sort(ship(s, d), {"volume": 2}).select("date", "volume_q", F.round("ret", 6).alias("ret"), "n"),
           f"with {SHIP}, {RETS}, k as (select *, rank() over (partition by date order by volume) + (count(volume) over (partition by date, volume) - 1) / 2.0::double as rk, count(volume) over {D} as cn from p), "
           f"q as (select *, lag(case when cn >= 2 then ceil(round(rk / cn * 2, 9)) end) over {T} as volume_q from k) select date, volume_q, round(avg(ret), 6) as ret, count(*) as n from q where ret is not null and volume_q is not null group by date, volume_q")  # fmt: skip
full_query("conditional_sort", lambda s, d: sorts.portfolio_sort(ship(s, d), {"volume": 2, "close": 2}, conditional=True).select("date", "volume_q", "close_q", F.round("ret", 6).alias("ret"), "n"),
           f"with {SHIP}, {RETS}, j as (select *, ceil(round((rank() over (partition by date order by volume) + (count(*) over (partition by date, volume) - 1) / 2.0::double) / count(*) over {D} * 2, 9)) as vq from p), "
           f"k as (select *, ceil(round((rank() over (partition by date, vq order by close) + (count(*) over (partition by date, vq, close) - 1) / 2.0::double) / count(*) over (partition by date, vq) * 2, 9)) as cq from j), "
           f"q as (select *, lag(vq) over {T} as volume_q, lag(cq) over {T} as close_q from k) select date, volume_q, close_q, round(avg(ret), 6) as ret, count(*) as n from q where ret is not null and volume_q is not null group by all")
full_query("information_coefficient", lambda s, d: sorts.information_coefficient(ship(s, d), "volume").select("date", F.round("ic", 6).alias("ic"), "n"),
           f"with {SHIP}, {RETS}, l as (select *, lag(volume) over {T} as f from p), s as (select * from l where f is not null and ret is not null), "
           "k as (select date, rank() over (partition by date order by f) + (count(*) over (partition by date, f) - 1) / 2.0::double as a, rank() over (partition by date order by ret) + (count(*) over (partition by date, ret) - 1) / 2.0::double as b from s) "
           "select date, round(case when count(*) >= 3 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end, 6) as ic, count(*) as n from k group by date")  # fmt: skip
full_query("contingency", lambda s, d: sorts.contingency(windows.quantize(windows.quantize(ship(s, d), "ret", "qa", 3, axis="cs"), "volume", "qb", 3, axis="cs"), "qa", "qb").select(*[F.round(c, 6).alias(c) for c in ("n", "chi2", "cramers_v", "tschuprow_t", "pearson_c", "mutual_information")]),
           f"with {SHIP}, {RETS}, {RANK}, l as (select *, case when cn >= 2 then ceil(round(rk / cn * 3, 9)) end as qa, rank() over (partition by date order by volume) + (count(*) over (partition by date, volume) - 1) / 2.0::double as vr, count(*) over {D} as vn from k), "
           f"q as (select qa, ceil(round(vr / vn * 3, 9)) as qb from l where qa is not null and vn >= 2), cells as (select qa, qb, count(*)::double as o from q group by all), "
           "e as (select *, sum(o) over (partition by qa) * sum(o) over (partition by qb) / sum(o) over () as x, sum(o) over () as n from cells), "
           "t as (select max(n) as n, sum(o * o / x) - max(n) as chi2, count(distinct qa) - 1 as r, count(distinct qb) - 1 as c, sum(o / n * ln(o / x)) as mi from e) "
           "select n, round(chi2, 6) as chi2, round(sqrt(chi2 / n / least(r, c)), 6) as cramers_v, round(sqrt(chi2 / n / sqrt(r * c)), 6) as tschuprow_t, round(sqrt(chi2 / (chi2 + n)), 6) as pearson_c, round(mi, 6) as mutual_information from t")
full_query("fama_macbeth", lambda s, d: sorts.fama_macbeth(windows.zscore(windows.zscore(ship(s, d), "volume", "zv", axis="cs", min_periods=3), "close", "zc", axis="cs", min_periods=3), "ret", ["zv", "zc"]).select("factor", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"), "n"),
           f"with {SHIP}, {RETS}, s as (select *, " + ", ".join(f"case when count({x}) over {D} >= 3 then ({x} - avg({x}) over {D}) / nullif(stddev_samp({x}) over {D}, 0) end as z_{x}" for x in ("volume", "close")) + " from p), "
           f"l as (select date, ret, lag(z_volume) over {T} as a, lag(z_close) over {T} as c from s), k as (select date, count(*) as n, sum(a * a) as aa, sum(c * c) as cc, sum(a * c) as ac, sum(a * ret) as ay, sum(c * ret) as cy "
           "from l where ret is not null and a is not null and c is not null group by date having count(*) >= 3), "
           "d as (select unnest(['zv', 'zc']) as factor, unnest([(cc * ay - ac * cy) / (aa * cc - ac * ac), (aa * cy - ac * ay) / (aa * cc - ac * ac)]) as v from k) "
           "select factor, round(avg(v), 6) as mean, round(stddev_samp(v) / sqrt(count(*)), 6) as se, round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 4) as t, count(*) as n from d group by factor")
full_query("pooled_regression", lambda s, d: sorts.pooled_regression(ship(s, d), "ret", ["volume"]).select("factor", F.round("coef", 8).alias("coef")),
           f"with {SHIP}, {RETS}, l as (select *, lag(volume) over {T} as f from p) select 'const' as factor, round(regr_intercept(ret, f), 8) as coef from l union all select 'volume', round(regr_slope(ret, f), 8) from l")
full_query("orthogonalize", lambda s, d: sorts.orthogonalize(ship(s, d), ["close", "volume"]).select("date", "ticker", F.round("close_orth", 6).alias("close_orth"), F.round("volume_orth", 6).alias("volume_orth")))
full_query("kendall_tau", lambda s, d: sorts.kendall_tau(panels.events_daily(s, d), "close", "volume"))

# Learning
full_query("pca", lambda s, d: learn.pca(ship(s, d), n_components=2).select("component", "ticker", F.round("loading", 6).alias("loading"), F.round("explained", 6).alias("explained")))
full_query("rolling_pca", lambda s, d: learn.windowed_pca(ship(s, d), window_size=120, every=1, n_components=2).select("date", "component", F.round("score", 6).alias("score"), F.round("explained", 6).alias("explained")))
full_query("ppca", lambda s, d: learn.ppca(ship(s, d), n_components=2).select("component", "ticker", F.round("loading", 4).alias("loading")))
for _model in ("ols", "ridge", "lasso", "elastic_net"):
    full_query(f"forecast_{_model}", lambda s, d, m=_model: learn.forecast(ship_market(s, d), "ret", ["market", "volume"], model=m, window_size=120, every=60).select("date", "ticker", F.round("prediction", 6).alias("prediction")))


# Selection, attribution, strategies
FEATURES = ["market", "volume", "close", "open"]
for _method in ("lars", "lasso", "ridge", "elastic_net", "lasso_lars_ic", "lasso_cv", "random_forest", "xgboost"):

    def _importance(s: SparkSession, d: str, method: str = _method) -> DataFrame:
        p = ship_market(s, d).withColumn("y", F.lead("ret", 1).over(signals.by_ticker()))
        more = {"n_estimators": 10, "max_depth": 3} if method in selection.TREES else {"alpha": 1e-4} if method in ("lasso", "elastic_net") else {}
        return selection.importance(p, "y", FEATURES, method, **more).select("feature", F.round("importance", 6).alias("importance"))

    full_query(f"importance_{_method}", _importance)


def lagged_fit(s: SparkSession, d: str) -> DataFrame:
    """Least squares of the next return on this return and the volume: scores of the fit."""
    p, y, x = selection.prepare(ship(s, d), "ret", ["volume"], 1, 0)
    found = selection.fit_scores(selection.predict(p, y, x), y, "prediction", len(x))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


full_query("lagged_fit", lagged_fit,
           f"with {SHIP}, {RETS}, a as (select *, lead(ret, 1) over {T} as y from p), v as (select * from a where y is not null and ret is not null and volume is not null), "
           "c as (select count(*) as n, avg(y) as my, avg(ret) as mr, avg(volume) as mv, covar_pop(ret, ret) as rr, covar_pop(volume, volume) as vv, covar_pop(ret, volume) as rv, covar_pop(ret, y) as ry, covar_pop(volume, y) as vy, var_pop(y) as yy from v), "
           "k as (select *, (ry * vv - vy * rv) / (rr * vv - rv * rv) as b1, (vy * rr - ry * rv) / (rr * vv - rv * rv) as b2 from c), "
           f"f as (select v.date, v.ticker, v.y, my + b1 * (ret - mr) + b2 * (volume - mv) as p, n, yy from v, k), g as (select *, y - lag(y) over {T} as dy, p - lag(p) over {T} as dp from f), "
           "s as (select avg((y - p) ** 2) as mse, avg(abs(y - p)) as mae, max(n) as n, max(yy) as yy, avg(case when sign(dy) = sign(dp) then 1.0::double when dy is not null then 0 end) as chg from g) "
           "select round(mse, 6) as mse, round(sqrt(mse), 6) as rmse, round(mae, 6) as mae, round(1 - mse / yy, 6) as r2, round(1 - mse / yy * (n - 1) / (n - 3), 6) as adj_r2, round(chg, 6) as chg_accuracy from s")  # fmt: skip
full_query("supervised_pca", lambda s, d: selection.supervised_pca(ship_market(s, d), "ret", FEATURES, n_feat=3, n_components=2).select("date", "ticker", F.round("prediction", 6).alias("prediction")))
full_query("windowed_predict", lambda s, d: selection.windowed_predict(ship_market(s, d), "ret", FEATURES, window_size=120, every=20).select("date", "ticker", F.round("prediction", 6).alias("prediction")))
full_query("spearman", lambda s, d: selection.spearman(ship(s, d), "ret", ["volume", "open"]).select("feature", "n", F.round("spearman_rank", 6).alias("spearman_rank")),
           f"with {SHIP}, {RETS} " + " union all ".join(f"select '{c}' as feature, count(*) as n, round(corr(a, b), 6) as spearman_rank from (select rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as a, rank() over (order by ret) + (count(*) over (partition by ret) - 1) / 2.0::double as b from p where {c} is not null and ret is not null)" for c in ("volume", "open")))
full_query("kendall", lambda s, d: selection.kendall(panels.events_daily(s, d), "close", "volume").select("feature", "n", F.round("kendall_tau", 6).alias("kendall_tau")),
           f"with {BARS}, x as (select row_number() over () as i, volume as x, close as y from b where volume is not null and close is not null), "
           "s as (select sum(sign(p.x - q.x) * sign(p.y - q.y)) as s, sum(abs(sign(p.x - q.x))) as a, sum(abs(sign(p.y - q.y))) as b from x p join x q on p.i < q.i) "
           "select 'volume' as feature, (select count(*) from x) as n, round(s / nullif(sqrt(a * b), 0), 6) as kendall_tau from s")  # fmt: skip
ORACLES["kendall_tau"] = (f"with {BARS}, x as (select ticker, row_number() over () as i, close as x, volume as y from b where volume is not null and close is not null) "
                          "select ticker, sum(sign(p.x - q.x) * sign(p.y - q.y)) / nullif(sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))), 0) as tau from x p join x q using (ticker) where p.i < q.i group by ticker")  # fmt: skip
full_query("fama_macbeth_each", lambda s, d: attribution.fama_macbeth_each(ship(s, d), "ret", ["volume", "open"], min_obs=3).select("factor", F.round("beta", 8).alias("beta"), F.round("std_error", 8).alias("std_error"), F.round("t_stat", 6).alias("t_stat")),
           f"with {SHIP}, {RETS}, l as (select *, lag(volume) over {T} as fv, lag(open) over {T} as fo from p), g as (select min(date) as first from (select date from l where ret is not null and fv is not null and fo is not null group by date having count(*) > 3)), "
           "d as (select date, sum(fv * ret) / sum(case when ret is not null then fv * fv end) as volume, sum(fo * ret) / sum(case when ret is not null then fo * fo end) as open from l, g where date >= first group by date) "
           + " union all ".join(f"select '{c}' as factor, round(avg({c}), 8) as beta, round(stddev_samp({c}) / sqrt(count({c})), 8) as std_error, round(avg({c}) / (stddev_samp({c}) / sqrt(count({c}))), 6) as t_stat from d" for c in ("volume", "open")))
full_query("pooled_each", lambda s, d: attribution.pooled_each(ship(s, d), "ret", ["volume", "open"]).select("factor", F.round("beta", 8).alias("beta"), F.round("r2", 8).alias("r2")),
           f"with {SHIP}, {RETS}, l as (select *, lag(volume) over {T} as fv, lag(open) over {T} as fo from p) select 'volume' as factor, round(regr_slope(ret, fv), 8) as beta, round(regr_r2(ret, fv), 8) as r2 from l union all select 'open', round(regr_slope(ret, fo), 8), round(regr_r2(ret, fo), 8) from l")
full_query("factor_covariance", lambda s, d: attribution.covariance_table(ship(s, d), ["open", "close"]).select("a", "b", F.round("covariance", 4).alias("covariance")),
           f"with {SHIP} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(covar_samp({a}, {b}), 4) as covariance from b" for a in ("open", "close") for b in ("open", "close")))
panel_query("beta_returns", ship_market, attribution.attribute, "beta_ret", "covar_samp(ret, market) over (partition by ticker) / nullif(var_samp(case when ret is not null then market end) over (partition by ticker), 0) * case when ret is not null then market end", of="m")
panel_query("alpha_returns", ship_market, attribution.attribute, "alpha_ret", "ret - covar_samp(ret, market) over (partition by ticker) / nullif(var_samp(case when ret is not null then market end) over (partition by ticker), 0) * market", of="m")
panel_query("period_change", ship, lambda p: attribution.period_change(p.withColumn("ret", F.expm1("ret")), 5), "pct_chg", f"case when row_number() over {T} > 5 then exp(sum(ret) over {rolling(5)}) - 1 end")
panel_query("raw_signal", ship, lambda p: signals.raw_signal(p, "ret"), "signal", "ret")
panel_query("dual_signals", ship, lambda p: signals.dual_signals(p, ["ret", "volume"]), "signal")
full_query("exposures", lambda s, d: attribution.exposures(ship_market(s, d), "ret", ["market"]).select("ticker", "factor", F.round("beta", 6).alias("beta")),
           f"with {SHIP}, {RETS}, {MARK} select ticker, 'market' as factor, round(regr_slope(ret, market), 6) as beta from m group by ticker")
for _method in ("ols", "ml"):
    full_query(f"mimicking_returns_{_method}", lambda s, d, m=_method: attribution.mimicking_returns(ship_market(s, d), "ret", ["market", "volume"], m).select("date", "factor", F.round("ret", 6).alias("ret")))
full_query("orthogonalize_rolling", lambda s, d: attribution.orthogonalize_windows(ship(s, d), ["close", "open"], "rolling", 60).select("date", "ticker", F.round("close_orth", 6).alias("close_orth"), F.round("open_orth", 6).alias("open_orth")))
full_query("turbulence", lambda s, d: calendar.turbulence(ship(s, d)).select("date", *[F.round(c, 6).alias(c) for c in ("turbulence", "magnitude", "correlation")]))
full_query("window_components", lambda s, d: calendar.window_components(ship(s, d)).select("date", "component", "ticker", F.round("loading", 6).alias("loading"), F.round("explained", 6).alias("explained")))
full_query("strategy_summary", lambda s, d: (f := strategy.summarize(strategy.run(ship(s, d), strategy.Strategy("inverse volatility", weights={"method": "inverse_volatility"}, rebalance="month_start")))).select(*[F.round(c, 6).alias(c) for c in f.columns]))


def flagship_long_short(spark: SparkSession, d: str) -> DataFrame:
    """Bars, log returns, expanding z-scores, cross-section ranks, yesterday's rank as signal, daily equal-weighted long/short return, yearly Sharpe ratio."""
    p = windows.zscore(scalars.log_return(panels.events_daily(spark, d)), "ret", "z", min_periods=3)
    p = windows.rank(p.withColumn("z", F.round("z", 10)), "z", "rank", axis="cs")
    p = signals.rank_signal(p, "rank", axis="cs", lags=1)
    daily = p.filter("signal is not null and ret is not null").groupBy("date").agg(F.avg(F.col("signal") * F.col("ret")).alias("r"))
    return daily.agg(F.count("r").alias("n_days"), F.round(F.avg("r"), 8).alias("mean"), F.round(F.avg("r") / F.stddev_samp("r") * math.sqrt(365), 6).alias("sharpe"))


full_query("flagship_long_short", flagship_long_short,
           f"with {BARS}, {RETS}, z as (select *, round({when_full('ret', 3, f'(ret - avg(ret) over {E}) / nullif(stddev_samp(ret) over {E}, 0)', E)}, 10) as z from p), "
           "k as (select *, case when z is not null and count(z) over (partition by date) >= 2 then rank() over (partition by date order by z nulls last) + (count(z) over (partition by date, z) - 1) / 2.0::double end as rk from z), "
           f"s as (select *, (rk - min(rk) over {D}) / nullif(max(rk) over {D} - min(rk) over {D}, 0) * 2 - 1 as s from k), l as (select *, lag(s) over {T} as g from s), "
           "y as (select date, avg(g * ret) as r from l where g is not null and ret is not null group by date) select count(r) as n_days, round(avg(r), 8) as mean, round(avg(r) / stddev_samp(r) * sqrt(365), 6) as sharpe from y")  # fmt: skip
