"""Kernels against closed forms, pandas and invariants."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest

from panelkiln.operators import factors, learn, portfolio, regress, risk, windows
from panelkiln.operators.base import Operator, Pipeline


@pytest.fixture
def r():
    rng = np.random.default_rng(3)
    return rng.normal(size=(200, 5)) @ np.diag([1, 2, 3, 1, 0.5]) * 0.01 + rng.normal(size=(200, 1)) * 0.01


@pytest.mark.parametrize("method", sorted(portfolio.OPTIMIZERS))
def test_weights_sum_to_one(r, method):
    w = portfolio.OPTIMIZERS[method](r, r.mean(0), risk.covariance(r))
    assert w.sum() == pytest.approx(1) and (w >= -1e-9).all()


def test_min_vol_is_least(r):
    c = risk.covariance(r)
    w = portfolio.min_vol(c)
    for v in np.random.default_rng(0).dirichlet(np.ones(5), 500):
        assert w @ c @ w <= v @ c @ v + 1e-12


def test_risk_parity_contributions_are_equal(r):
    c = risk.covariance(r)
    w = portfolio.risk_parity(c)
    part = w * (c @ w)
    assert np.allclose(part, part.mean())


@pytest.mark.parametrize("name", sorted(risk.ESTIMATORS))
def test_estimators_are_symmetric_and_positive(r, name):
    c = risk.ESTIMATORS[name](r)
    assert np.allclose(c, c.T) and np.linalg.eigvalsh(c)[0] > -1e-12


def test_student_t():
    assert regress.two_sided_t(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert regress.two_sided_t(0.0, 5) == pytest.approx(1)
    assert regress.two_sided_t(12.706205, 1) == pytest.approx(0.05, abs=1e-6)


def test_adf_tells_a_walk_from_noise():
    e = np.random.default_rng(1).normal(size=400)
    assert regress.adf(e)["stat"] < -5 < regress.adf(e.cumsum())["stat"]


def test_box_cox_of_lognormal_is_log():
    x = np.exp(np.random.default_rng(2).normal(size=5000))
    assert windows._best_lambda(x, windows.BoxCox) == pytest.approx(0, abs=0.05)


def test_pca_alignment_undoes_order_and_signs():
    v = np.linalg.qr(np.random.default_rng(5).normal(size=(6, 3)))[0]
    order, sign = learn.align(-v[:, [2, 0, 1]], v)
    assert np.allclose(-v[:, [2, 0, 1]][:, order] * sign, v)


def test_lasso_drops_what_is_noise():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 4))
    b, _ = learn.fit_linear(x, 2 * x[:, 0] + 0.1 * rng.normal(size=500), "lasso", 0.1)
    assert b[0] > 1.5 and np.allclose(b[1:], 0)


def test_contracts(spark):
    df = spark.createDataFrame([(1.0,)], "close double")
    op = Operator(lambda d, k: d.withColumn("x", d.close * k), name="times", inputs=("close",), k=3)
    assert Pipeline([("a", op)]).fit_transform(df).first()["x"] == 3 and op.get_metadata()["is_fitted"]
    with pytest.raises(ValueError, match="times needs"):
        op.compute(df.drop("close"))


def test_ewm_is_pandas(spark):
    x = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=30).date, "ticker": "a", "ret": np.random.default_rng(0).normal(size=30)})
    x.loc[[0, 7, 8], "ret"] = np.nan
    df = spark.createDataFrame(x).replace(float("nan"), None)
    got = windows.std(df, window_type="ewm", window_size=10).toPandas().sort_values("date")["std"].to_numpy()
    assert np.allclose(got, x["ret"].ewm(span=10, min_periods=2).std().to_numpy(), equal_nan=True)


def test_windows_of_empty_and_null_panels(spark):
    empty = spark.createDataFrame([], "date date, ticker string, ret double, close double")
    nulls = spark.createDataFrame([(None, "a", None, None)], empty.schema)
    for df in (empty, nulls):
        for op in (windows.zscore, windows.rank, windows.percentile, windows.min_max_scaler):
            assert op(df, "close").count() == df.count()


def test_single_linkage():
    d = np.array([[0, 1, 5], [1, 0, 4], [5, 4, 0]], float)
    assert portfolio.linkage(d)[0][:3] == (0, 1, 1.0) and portfolio.linkage(d)[1][2] == 4.0
    assert math.isclose(portfolio.hrp(np.random.default_rng(0).normal(size=(50, 4))).sum(), 1)


def panel(spark, x: pd.DataFrame):
    """A long panel of a wide frame, whose missing values are NULL."""
    long = x.rename_axis(index="date", columns="ticker").stack(future_stack=True).rename("ret").reset_index()
    return spark.createDataFrame(long, "date date, ticker string, ret double").replace(float("nan"), None)


def test_each_date_has_the_weights_of_its_window(spark, r):
    x = pd.DataFrame(r[:75], index=pd.date_range("2024-01-01", periods=75).date, columns=list("abcde"))
    for every, expanding in ((1, False), (7, False), (45, False), (7, True)):
        got = portfolio.windowed_weights(panel(spark, x), method="inverse_variance", window_size=20, every=every, expanding=expanding).toPandas().pivot(index="date", columns="ticker", values="weight").sort_index()
        ends = range(19, 75, every)
        assert list(got.index) == [x.index[e] for e in ends]
        for e, w in zip(ends, got.to_numpy(), strict=True):
            iv = 1 / r[0 if expanding else e - 19 : e + 1].var(0)
            assert np.allclose(w, iv / iv.sum())


def test_simplex_by_sorting_is_the_nearest_point():
    rng = np.random.default_rng(4)
    for v in rng.normal(size=(50, 6)) * 3:
        w = portfolio._simplex(v)
        assert np.allclose(w, portfolio._simplex(v, low=-1e-300)) and w.sum() == pytest.approx(1)


def test_strides_leave_no_date_without_components(spark, r):
    x = pd.DataFrame(r[:60], index=pd.date_range("2024-01-01", periods=60).date, columns=list("abcde"))
    one, ten = (learn.windowed_pca(panel(spark, x), window_size=20, every=n).toPandas().set_index(["date", "component"]).sort_index() for n in (1, 10))
    assert len(one) == len(ten) == 41 * 2 and list(one.index) == list(ten.index)
    _, v, _ = learn.fit_pca(r[:20], 2)
    z = (r[24] - r[:20].mean(0)) / r[:20].std(0) @ v
    assert np.allclose(ten.loc[x.index[24], "score"], z) and np.allclose(ten.loc[x.index[19], "score"], one.loc[x.index[19], "score"])


def test_weights_and_components_are_registered_for_every_date(spark):
    from panelkiln.plans import registry

    dates = registry.ship(spark, "/root/testdata/sf0.01").select("date").distinct().count()
    for name in ("optimize_inverse_variance", "min_vol_oas"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").select("date").distinct().count() == dates - 59


def test_late_names_take_no_dates_from_others(spark, r):
    x = pd.DataFrame(r[:60], index=pd.date_range("2024-01-01", periods=60).date, columns=list("abcde"))
    x.iloc[:40, 4] = np.nan
    x.iloc[45, 0] = np.nan
    got = learn.windowed_pca(panel(spark, x), window_size=20).toPandas().pivot(index="date", columns="component", values="score").sort_index()
    assert list(got.index) == list(x.index[19:]) and got.notna().all().all()
    for i, names in ((30, [0, 1, 2, 3]), (59, [1, 2, 3, 4])):
        s = learn.fit_pca(r[i - 19 : i + 1][:, names], 2)[0][-1]
        assert np.allclose(np.sort(np.abs(got.loc[x.index[i]])), np.sort(np.abs(s)))


def test_windows_with_gaps_in_all_names_keep_their_dates(spark, r):
    x = pd.DataFrame(r[:40], index=pd.date_range("2024-01-01", periods=40).date, columns=list("abcde"))
    for k in range(5):
        x.iloc[10 + k, k] = np.nan
    got = learn.windowed_pca(panel(spark, x), window_size=20).toPandas().pivot(index="date", columns="component", values="score").sort_index()
    assert list(got.index) == list(x.index[19:]) and got.notna().all().all()


def test_graphical_lasso_keeps_variances():
    deviations = np.array([0.005, 0.01, 0.02, 0.03, 0.04])
    r = np.random.default_rng(5).normal(size=(4000, 5)) * deviations
    s = np.cov(r, rowvar=False, bias=True)
    w = risk.graphical_lasso(r, 0.01)
    assert np.allclose(np.diag(w), np.diag(s)) and np.allclose(w, np.diag(np.diag(s)), atol=1e-6)
    loose = risk.graphical_lasso(r, 0.0)
    assert np.allclose(loose, s, atol=1e-8)


def test_edge_is_the_estimator_bar_by_bar(spark):
    rng = np.random.default_rng(9)
    close = np.exp(np.cumsum(rng.normal(0, 0.02, 40)))
    open_ = close * np.exp(rng.normal(0, 0.01, 40))
    high, low = np.maximum(open_, close) * np.exp(abs(rng.normal(0, 0.005, 40))), np.minimum(open_, close) * np.exp(-abs(rng.normal(0, 0.005, 40)))
    high[7] = open_[7] = low[7] = close[6] = high[6] = close[7] = low[6]
    rows = [(datetime.date(2024, 1, 1) + datetime.timedelta(i), "a", *map(float, x), "kept") for i, x in enumerate(zip(open_, high, low, close, strict=True))]
    df = spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, _edge_mid string")
    got = factors.edge(df, window_size=10, sign=True).orderBy("date").collect()
    assert {r["_edge_mid"] for r in got} == {"kept"} and all(r["edge_spread"] is None for r in got[:9])
    for end in range(10, 41):
        O, H, L, C = (np.log(x[end - 10 : end]) for x in (open_, high, low, close))
        M = (H + L) / 2
        bars = range(1, 10)
        live = [float(H[t] != L[t] or L[t] != C[t - 1]) for t in bars]
        p_open = sum(k * (int(O[t] != H[t]) + int(O[t] != L[t])) for k, t in zip(live, bars, strict=True)) / 9
        p_close = sum(k * (int(C[t - 1] != H[t - 1]) + int(C[t - 1] != L[t - 1])) for k, t in zip(live, bars, strict=True)) / 9
        centred = lambda x: [v - sum(x) / sum(live) * k for v, k in zip(x, live, strict=True)]
        u, v, n = centred([M[t] - O[t] for t in bars]), centred([M[t] - C[t - 1] for t in bars]), centred([O[t] - C[t - 1] for t in bars])
        first = [-4 / p_open * a * (O[t] - M[t - 1]) - 4 / p_close * b * (C[t - 1] - M[t - 1]) for a, b, t in zip(u, v, bars, strict=True)]
        second = [-4 / p_open * a * (O[t] - C[t - 1]) - 4 / p_close * b * (C[t - 1] - M[t - 1]) for a, b, t in zip(u, n, bars, strict=True)]
        squared = np.average([np.mean(first), np.mean(second)], weights=[np.var(second), np.var(first)])
        assert np.isclose(got[end - 1]["edge_spread"], np.sign(squared) * np.sqrt(abs(squared)), atol=1e-7)
