"""Selection, attribution and calendar operators against closed forms and brute force."""

import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkiln.operators import attribution, calendar, learn, portfolio, risk, selection, sorts
from panelkiln.plans import registry, strategy

from test_oracles import SF, con, rows  # noqa: F401


@pytest.fixture
def sample():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    return x, x @ np.array([1.0, 0, -2, 0, 0.5]) + rng.normal(size=300)


def test_lasso_path_meets_the_optimality_conditions(sample):
    m = selection.of_rows(*sample)
    g, c = m.cov[:-1, :-1], m.cov[:-1, -1]
    path = selection.angle_path(g, c, True)
    for alpha in np.linspace(0.001, path[0][0] * 0.99, 25):
        b = selection.along(path, alpha)
        left = c - g @ b
        assert np.abs(left).max() <= alpha * (1 + 1e-6)
        assert np.allclose(left[b != 0], alpha * np.sign(b[b != 0]), atol=1e-8)
        for l1 in (1.0, 0.3):
            e = selection.shrunk(g, c, alpha, l1)
            left = c - g @ e - alpha * (1 - l1) * e
            assert np.abs(left).max() <= alpha * l1 * (1 + 1e-6) and np.allclose(left[e != 0], alpha * l1 * np.sign(e[e != 0]), atol=1e-8)


def test_least_angles_end_at_least_squares(sample):
    x, y = sample
    want = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    for method in ("ols", "lars"):
        b, b0 = selection.solve(selection.of_rows(x, y), method)
        assert np.allclose([*b, b0], want)
    assert (selection.solve(selection.of_rows(x, y), "lars", most=2)[0] != 0).sum() == 2


def test_moments_add_and_score_folds(sample):
    x, y = sample
    parts = [selection.of_rows(x[i : i + 60], y[i : i + 60]) for i in range(0, 300, 60)]
    whole = sum(parts[1:], parts[0])
    assert whole.n == 300 and np.allclose(whole.cov, selection.of_rows(x, y).cov)
    b, b0 = selection.solve(whole, "ridge", 2.0)
    assert whole.error(b, b0) == pytest.approx(((y - x @ b - b0) ** 2).mean())
    assert selection.solve_cv(parts, "lasso")[2] < 0.5
    assert selection.solve(whole, "ridge", 2.0)[0] == pytest.approx(np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 2 * np.eye(5), (x - x.mean(0)).T @ (y - y.mean())))


def test_criterion_is_that_of_the_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8))
    y = x[:, 0] * 3 - x[:, 5] + rng.normal(size=500)
    m = selection.of_rows(x, y)
    z, t = x - x.mean(0), y - y.mean()
    noise = ((t - z @ np.linalg.lstsq(z, t, rcond=None)[0]) ** 2).sum() / (500 - 9)
    for name, price in (("aic", 2), ("bic", np.log(500))):
        b = selection.by_criterion(m, name)
        cost = lambda v: ((t - z @ v) ** 2).sum() / noise + price * (v != 0).sum()  # noqa: B023, E731
        assert {0, 5} <= set(np.flatnonzero(b))
        assert cost(b) == pytest.approx(min(cost(v) for _, v in selection.angle_path(m.cov[:-1, :-1], m.cov[:-1, -1], True)))


def test_concordance():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300):
        cells = pd.Series(list(zip(rng.integers(0, 12, n), rng.integers(0, 9, n), strict=True))).value_counts()
        p = [(*k, w) for k, w in cells.items()]
        want = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) * a[2] * b[2] for a, b in itertools.combinations(p, 2))
        x, y, w = (np.array([q[i] for q in p], float) for i in range(3))
        assert sorts.concordance(x, y, w) == pytest.approx(want)


def test_cross_validated_graphical_lasso_keeps_variances():
    r = np.random.default_rng(2).normal(size=(200, 4)) * [0.01, 0.02, 0.03, 0.01]
    c = risk.graphical_lasso_cv(r)
    assert np.allclose(np.diag(c), r.var(0)) and np.abs(risk.to_corr(c) - np.eye(4)).max() < 0.15


def test_corner():
    assert (portfolio.round_corner(np.array([0.99995, 0.00005])) == [1, 0]).all()
    assert (portfolio.round_corner(np.array([0.9, 0.1])) == [0.9, 0.1]).all()


@pytest.mark.parametrize("name", ["lagged_fit", "spearman", "kendall", "fama_macbeth_each", "pooled_each", "factor_covariance", "beta_returns", "alpha_returns", "period_change", "exposures"])
def test_sql(spark, con, name):  # noqa: F811
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())


def test_kendall_by_ticker(spark, con):  # noqa: F811
    got, want = registry.QUERIES["kendall_tau"](spark, SF).toPandas(), con.sql(registry.ORACLES["kendall_tau"]).df()
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(80)]
    pdf = pd.DataFrame([(d, t, *rng.normal(size=4)) for d in days for t in ("a", "b", "c", "d")], columns=["date", "ticker", "ret", "x", "z", "v"])
    pdf["ret"] = pdf["ret"] * 0.01
    return pdf, spark.createDataFrame(pdf).cache()


def test_forecasts_use_what_is_known(panel):
    pdf, df = panel
    got = selection.windowed_predict(df, "ret", ["x", "z"], "ols", window_size=20, target_lookahead=2).toPandas()
    assert len(got) == 4 * (80 - 21)
    t = pdf[pdf.ticker == "b"].reset_index(drop=True)
    x, y = t[["ret", "x", "z"]].to_numpy(), t["ret"].shift(-2).to_numpy()
    b, b0 = selection.solve(selection.of_rows(x[29:49], y[29:49]))
    assert got[(got.ticker == "b") & (got.date == t.date[50])]["prediction"].item() == pytest.approx(x[50] @ b + b0)
    less = selection.windowed_predict(df, "ret", ["x", "z"], "ols", window_size=20, n_feat=2, every=7).toPandas()
    assert less["prediction"].notna().all() and len(less) == 4 * 60


def test_supervised_pca_of_all_components_is_least_squares(panel):
    _, df = panel
    led = selection.supervised_pca(df, "ret", ["x", "z", "v"], regression="ols").orderBy("ticker", "date").toPandas()
    p, y, x = selection.prepare(df.select("date", "ticker", "ret", "x", "z", "v"), "ret", ["x", "z", "v"], 1, 0)
    want = selection.predict(p, y, x).orderBy("ticker", "date").toPandas()
    assert np.allclose(led["prediction"], want["prediction"])


def test_windows_of_the_calendar(panel):
    pdf, df = panel
    wide = pdf.pivot(index="date", columns="ticker", values="ret")
    got = calendar.turbulence(df, window_size=30).toPandas().sort_values("date")
    assert len(got) == 51
    assert got["turbulence"].iloc[7] == pytest.approx(risk.turbulence(wide.iloc[7:37].to_numpy(), wide.iloc[36].to_numpy())["turbulence"])
    grown = calendar.window_components(df, window_size=30, expanding=True, every=25).toPandas()
    assert sorted(set(grown["date"])) == [wide.index[29], wide.index[54], wide.index[79]]
    v = learn.fit_pca(wide.to_numpy(), 2)[1]
    last = grown[grown.date == wide.index[79]].pivot(index="ticker", columns="component", values="loading")
    assert np.allclose(last.to_numpy(), v)


def test_orthogonal_windows(panel):
    pdf, df = panel
    got = attribution.orthogonalize_windows(df, ["x", "z"], "rolling", 40).toPandas()
    t = pdf[pdf.ticker == "c"][["x", "z"]].to_numpy()[11:51]
    want = (t[-1] - t.mean(0)) @ attribution.lowdin(np.cov(t, rowvar=False))
    row = got[(got.ticker == "c") & (got.date == pdf.date.unique()[50])]
    assert row[["x_orth", "z_orth"]].to_numpy()[0] == pytest.approx(want)
    fixed = attribution.orthogonalize_windows(df, ["x", "z"]).filter("ticker = 'a'").toPandas()
    assert abs(np.corrcoef(fixed["x_orth"], fixed["z_orth"])[0, 1]) < 1e-9


def test_dependent_columns_stay_bounded():
    x = np.random.default_rng(0).normal(size=(50, 1))
    x = np.column_stack([x, x * (1 + 1e-13)])
    assert np.abs((x - x.mean(0)) @ attribution.lowdin(np.cov(x, rowvar=False))).max() < 10


def test_mimicking_portfolios_have_unit_exposure(panel):
    _, df = panel
    beta = attribution.exposures(df, "ret", ["x", "z"]).toPandas().pivot(index="ticker", columns="factor", values="beta")
    for method in ("ols", "ml"):
        w = attribution.mimicking_weights(df, "ret", ["x", "z"], method).toPandas().pivot(index="ticker", columns="factor", values="weight")
        assert np.allclose(beta.to_numpy().T @ w.to_numpy(), np.eye(2))


def test_strategy(panel):
    _, df = panel
    account = strategy.run(df, strategy.Strategy("s", weights={"method": "equal_weight", "window_size": 20}, rebalance=10, cost=0.0))
    s, last = strategy.summarize(account).first(), account.orderBy(F.desc("date")).first()
    assert s["periods"] == 80 and s["total_return"] == pytest.approx(last["value"] - 1)
    assert attribution.annual_factor(df) == 365
    trades = account.filter("turnover > 0").count()
    assert trades <= 7


def test_no_rows(panel):
    _, df = panel
    none = df.limit(0)
    assert selection.importance(none, "ret", ["x"], "lasso").count() == 0
    assert selection.predict(none, "ret", ["x"]).count() == 0
    assert attribution.exposures(none, "ret", ["x"]).count() == 0
