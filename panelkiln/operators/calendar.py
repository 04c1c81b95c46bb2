"""Functions of a window of dates by tickers, at each date of the calendar."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, TICKER, Window
from panelkiln.operators import learn, risk


def over_windows(df: DataFrame, value_col: str, function: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, window_size: int = 60, every: int = 1, expanding: bool = False, complete: bool = True) -> DataFrame:
    """date and the rows that `function` makes of the window (dates by tickers) that ends there, at every n-th date from the first full window on.

    Dates are numbered over the calendar and cut in blocks of window_size; a row goes to the blocks whose windows hold it: two at most, all later ones
    if expanding. A block is one kernel. With `complete`, dates that all names miss and names with a gap are left out. `schema` has no date.
    """
    days = df.select(DATE).filter(F.col(DATE).isNotNull()).distinct()
    days = days.withColumn("_n", F.row_number().over(Window.orderBy(DATE)) - 1)  # one row per date of the calendar
    last = days.agg(F.max("_n")).first()[0] or 0
    final = F.lit(last // window_size)
    upto = final if expanding else F.least(F.floor((F.col("_n") + window_size - 1) / window_size), final)
    rows = df.join(days, DATE).select(TICKER, F.col(value_col).cast("double").alias("_v"), "_n")
    sent = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_n") / window_size), upto)))
    names = [x.split()[0] for x in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["_b"].iloc[0])
        panel = pdf.pivot(index="_n", columns=TICKER, values="_v").sort_index()
        out = [pd.DataFrame(columns=["_n", *names])]
        for end in range(max(b * window_size, window_size - 1), min((b + 1) * window_size - 1, last) + 1):
            if (end - window_size + 1) % every:
                continue
            wide = panel.loc[0 if expanding else end - window_size + 1 : end]
            if complete:
                wide = wide.dropna(how="all").dropna(axis=1)
            made = function(wide) if wide.size else None
            if made is not None:
                out.append(made.assign(_n=end))
        return pd.concat(out[1:] or out)[["_n", *names]]

    return sent.repartition(last // window_size + 1, "_b").groupBy("_b").applyInPandas(run, f"_n long, {schema}").join(days, "_n").select(DATE, *names)


def turbulence(df: DataFrame, return_col: str = "ret", window_size: int = 60, expanding: bool = False) -> DataFrame:
    """date, turbulence, magnitude, correlation of each window's last date against the window, where it has rows enough and a return."""

    def one(wide: pd.DataFrame) -> pd.DataFrame | None:
        r = wide.to_numpy()
        return pd.DataFrame([risk.turbulence(r, r[-1])]) if len(r) > 2 and (r.std(0) > 0).all() else None

    return over_windows(df, return_col, one, "turbulence double, magnitude double, correlation double", window_size, expanding=expanding)


def window_components(df: DataFrame, value_col: str = "ret", window_size: int = 120, n_components: int = 2, expanding: bool = False, every: int = 1) -> DataFrame:
    """date, component, ticker, loading, explained of each window, the first loadings' sum not negative; windows are independent, so they run side by side."""

    def one(wide: pd.DataFrame) -> pd.DataFrame | None:
        if min(len(wide) - 1, wide.shape[1]) < n_components:
            return None
        _, v, e = learn.fit_pca(wide.to_numpy(), n_components)
        return pd.DataFrame([(k + 1, t, v[j, k], e[k]) for k in range(n_components) for j, t in enumerate(wide.columns)], columns=["component", "ticker", "loading", "explained"])

    return over_windows(df, value_col, one, "component long, ticker string, loading double, explained double", window_size, every, expanding)


def window_covariance(df: DataFrame, return_col: str = "ret", estimator: str = "covariance", window_size: int = 60, every: int = 1, expanding: bool = False) -> DataFrame:
    """date, a, b, covariance of each window by any of the estimators."""

    def one(wide: pd.DataFrame) -> pd.DataFrame | None:
        if len(wide) < 2:
            return None
        c = np.atleast_2d(risk.ESTIMATORS[estimator](wide.to_numpy()))
        return pd.DataFrame([(a, b, c[i, j]) for i, a in enumerate(wide.columns) for j, b in enumerate(wide.columns)], columns=["a", "b", "covariance"])

    return over_windows(df, return_col, one, "a string, b string, covariance double", window_size, every, expanding)
