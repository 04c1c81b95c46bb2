"""A strategy from signal to account: what to compute, how to weight, when to trade, what it costs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, Window
from panelkiln.operators import attribution, portfolio, signals


@dataclass
class Strategy:
    """`features` turns a panel into one with signals; `weights` are arguments of portfolio.windowed_weights; weights change on the dates of `rebalance`."""

    name: str
    features: Callable[[DataFrame], DataFrame] = lambda df: df
    weights: dict = field(default_factory=dict)
    cost: float = 0.001
    rebalance: str | int = "daily"


def rebalanced(weights: DataFrame, rebalance: str | int) -> DataFrame:
    """Weights of the dates to trade at."""
    days = weights.select(DATE).distinct()  # one row per date of the calendar
    number = F.row_number().over(Window.orderBy(DATE)) - 1
    days = days.withColumn("_n", number)
    return weights.join(days.filter(signals.rebalance_days(F.col(DATE), rebalance, F.col("_n"))).select(DATE), DATE)


def run(df: DataFrame, strategy: Strategy, return_col: str = "ret", start_value: float = 1.0) -> DataFrame:
    """date, value, ret, cost, turnover of the strategy's account."""
    panel = strategy.features(df)
    weights = rebalanced(portfolio.windowed_weights(panel, return_col, **({"every": 1} | strategy.weights)), strategy.rebalance)
    return portfolio.backtest(panel, weights, return_col, strategy.cost, start_value)


def summarize(account: DataFrame, start_value: float = 1.0, ann_factor: int = 365) -> DataFrame:
    """One row: total and yearly return, volatility, Sharpe ratio and periods of an account."""
    return attribution.summary(account, "value", start_value, ann_factor)
