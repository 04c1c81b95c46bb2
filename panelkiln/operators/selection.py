"""Feature selection and regression forecasts over all rows at once.

Linear models need only counts, means and covariances. These are one aggregate of the cluster, k (k + 3) / 2 numbers for k features whatever the
rows; the driver solves a system of that size, and predictions are column expressions. Trees are Spark ML's. Features aren't standardised.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.frames import DATE, TICKER, Window, by_ticker
from panelkiln.operators import regress, sorts

TREES = ("random_forest", "xgboost")


@dataclass
class Moments:
    """Of the features first and the target last: rows, means, and covariances over n."""

    n: float
    mean: np.ndarray
    cov: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(n, self.mean + d * other.n / n, (self.n * self.cov + other.n * other.cov) / n + np.outer(d, d) * self.n * other.n / n**2)

    def error(self, b: np.ndarray, b0: float) -> float:
        """Mean squared error of b0 + b x on these rows."""
        v = np.append(-b, 1.0)
        return float(v @ self.cov @ v + (v @ self.mean - b0) ** 2)


def prepare(df: DataFrame, target_col: str, feature_cols: list[str], target_lookahead: int = 1, feature_lags: int = 6) -> tuple[DataFrame, str, list[str]]:
    """Adds {target}_F{lookahead} and {column}_L1.. of the target and the features; gives the panel, the target's name and the predictors'."""
    w, ahead = by_ticker(), f"{target_col}_F{target_lookahead}"
    cols = list(dict.fromkeys([target_col, *feature_cols]))
    lags = {f"{c}_L{k}": F.lag(c, k).over(w) for c in cols for k in range(1, feature_lags + 1)}
    df = df.withColumns(lags | {ahead: F.lead(target_col, target_lookahead).over(w) if target_lookahead else F.col(target_col)})
    return df, ahead, [x for c in cols for x in (c, *(f"{c}_L{k}" for k in range(1, feature_lags + 1)))]


def moments(df: DataFrame, target_col: str, feature_cols: list[str], folds: int = 1) -> list[Moments]:
    """Of the rows without a null among the columns, by fold. Folds are stretches of dates with about equal rows; their bounds are quantiles of the dates."""
    cols = [*feature_cols, target_col]
    rows = df.select(F.datediff(F.col(DATE), F.lit("1970-01-01")).alias("_d"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).dropna()
    k = len(cols)
    fold = F.lit(0)
    if folds > 1:
        cuts = rows.agg(F.percentile_approx("_d", [i / folds for i in range(1, folds)], 10000).alias("q")).first()["q"] or []
        fold = sum((F.col("_d") > int(q)).cast("int") for q in cuts) if cuts else fold
    sums = [F.avg(f"_{i}").alias(f"m{i}") for i in range(k)] + [F.covar_pop(f"_{i}", f"_{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    out = []
    for r in rows.groupBy(fold.alias("_f")).agg(F.count(F.lit(1)).alias("n"), *sums).orderBy("_f").collect():  # a row per fold
        cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
        out.append(Moments(float(r["n"]), np.array([r[f"m{i}"] for i in range(k)], float), cov))
    return out


def of_rows(x: np.ndarray, y: np.ndarray) -> Moments:
    z = np.column_stack([x, y])
    return Moments(float(len(z)), z.mean(0), np.atleast_2d(np.cov(z, rowvar=False, bias=True)))


def angle_path(g: np.ndarray, c: np.ndarray, lasso: bool, most: int | None = None) -> list[tuple[float, np.ndarray]]:
    """(penalty, coefficients) at each knot of least-angle regression, or of the lasso, from covariances of features (g) and with the target (c)."""
    k = len(c)
    b, active, signs, barred = np.zeros(k), [], {}, None
    left = c.copy()
    level = np.abs(left).max(initial=0)
    tiny = 1e-12 * max(level, 1e-300)
    path = [(float(level), b.copy())]
    for _ in range(8 * k):
        rest = [j for j in range(k) if j not in signs and j != barred and g[j, j] > 0]
        if barred is None and rest:
            j = max(rest, key=lambda i: abs(left[i]))
            signs[j] = np.sign(left[j]) or 1.0
            active.append(j)
            rest.remove(j)
        if not active or level <= tiny:
            break
        d = np.linalg.pinv(g[np.ix_(active, active)]) @ np.array([signs[j] for j in active])
        slope = g[:, active] @ d
        step = level
        for j in [*rest, *([barred] if barred is not None else [])]:
            for gap, rate in ((level - left[j], 1 - slope[j]), (level + left[j], 1 + slope[j])):
                if rate > 1e-12 and tiny < gap / rate < step:
                    step = gap / rate
        barred, gone = None, None
        if lasso:
            for i, j in enumerate(active):
                at = -b[j] / d[i] if d[i] else -1.0
                if tiny < at < step:
                    step, gone = at, j
        b[active] += step * d
        left, level = c - g @ b, level - step
        if gone is not None:
            b[gone] = 0.0
            active.remove(gone)
            del signs[gone]
            barred = gone
        path.append((float(max(level, 0.0)), b.copy()))
        if most is not None and len(active) >= most or level <= tiny:
            break
    return path


def along(path: list[tuple[float, np.ndarray]], alpha: float) -> np.ndarray:
    """Coefficients at a penalty between knots."""
    for (a, x), (b, y) in zip(path, path[1:], strict=False):
        if alpha >= a:
            return x
        if alpha >= b:
            return x + (y - x) * (a - alpha) / ((a - b) or 1)
    return path[-1][1]


def shrunk(g: np.ndarray, c: np.ndarray, alpha: float, l1_ratio: float) -> np.ndarray:
    """Elastic net: the lasso at covariances whose diagonal holds the quadratic penalty. Exact, however close the features are."""
    return along(angle_path(g + alpha * (1 - l1_ratio) * np.eye(len(c)), c, True), alpha * l1_ratio)


def by_criterion(m: Moments, criterion: str = "aic") -> np.ndarray:
    """The knot of the lasso path with the least information criterion, at the noise of the least-squares fit."""
    g, c, k = m.cov[:-1, :-1], m.cov[:-1, -1], len(m.mean) - 1
    if m.n <= k + 1:
        raise ValueError("the criterion needs more rows than features")
    rss = lambda b: m.n * max(m.cov[-1, -1] - 2 * b @ c + b @ g @ b, 0.0)
    noise = rss(np.linalg.pinv(g) @ c) / (m.n - k - 1) or 1e-300
    price = 2.0 if criterion == "aic" else math.log(m.n)
    return min((b for _, b in angle_path(g, c, True)), key=lambda b: rss(b) / noise + price * (b != 0).sum())


def solve(m: Moments, method: str = "ols", alpha: float | None = None, l1_ratio: float = 0.5, criterion: str = "aic", most: int | None = None) -> tuple[np.ndarray, float]:
    """Coefficients and intercept. Penalties are per row for the lasso and the elastic net, and of the sum of squares for ridge."""
    g, c = m.cov[:-1, :-1], m.cov[:-1, -1]
    if method == "ols":
        b = np.linalg.pinv(g) @ c
    elif method == "ridge":
        b = np.linalg.solve(m.n * g + (1.0 if alpha is None else alpha) * np.eye(len(c)), m.n * c)
    elif method == "lars":
        b = angle_path(g, c, False, most)[-1][1]
    elif method in ("lasso", "lasso_lars"):
        b = along(angle_path(g, c, True), 1.0 if alpha is None else alpha)
    elif method == "lasso_lars_ic":
        b = by_criterion(m, criterion)
    elif method == "elastic_net":
        b = shrunk(g, c, 1.0 if alpha is None else alpha, l1_ratio)
    else:
        raise ValueError(f"no such method: {method}")
    return b, float(m.mean[-1] - b @ m.mean[:-1])


def solve_cv(parts: list[Moments], method: str, l1_ratio: float = 0.5, alphas: list[float] | None = None) -> tuple[np.ndarray, float, float]:
    """Coefficients, intercept and the penalty with the least error on folds left out; all folds are made of their moments, in no further pass.

    `method` is lasso, lasso_lars, lars, ridge or elastic_net. For lars, the penalty stands for the place on its path.
    """
    if len(parts) < 2:
        raise ValueError("cross-validation needs rows in two folds or more")
    add = lambda some: sum(some[1:], some[0])
    whole = add(parts)
    if alphas is None:
        top = np.abs(whole.cov[:-1, -1]).max(initial=0) / (l1_ratio if method == "elastic_net" else 1)
        alphas = [0.1, 1.0, 10.0] if method == "ridge" else list(np.geomspace(top or 1.0, (top or 1.0) * 1e-3, 100))

    def fits(m: Moments) -> list[np.ndarray]:
        g, c = m.cov[:-1, :-1], m.cov[:-1, -1]
        if method in ("lasso", "lasso_lars", "lars"):
            path = angle_path(g, c, method != "lars")
            return [along(path, a) for a in alphas]
        return [solve(m, method, a, l1_ratio)[0] for a in alphas]

    error = np.zeros(len(alphas))
    for i, test in enumerate(parts):
        train = add([p for j, p in enumerate(parts) if j != i])
        error += [test.n * test.error(b, float(train.mean[-1] - b @ train.mean[:-1])) for b in fits(train)]
    at = int(np.argmin(error))
    b = fits(whole)[at]
    return b, float(whole.mean[-1] - b @ whole.mean[:-1]), float(alphas[at])


def ranked(names: list[str], values, n_feat: int | None = None) -> list[tuple[int, str, float]]:
    """(rank, feature, importance), largest absolute value first; what has none is left out."""
    some = sorted(((n, float(v)) for n, v in zip(names, values, strict=True) if v), key=lambda x: (-abs(x[1]), x[0]))
    return [(i + 1, n, v) for i, (n, v) in enumerate(some[:n_feat])]


def fit_trees(df: DataFrame, target_col: str, feature_cols: list[str], method: str = "random_forest", n_estimators: int = 100, max_depth: int = 5, seed: int = 0):
    """A fitted forest, or boosted trees, and the panel's rows with `_x`; rows with a null among the features take no part."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rows = VectorAssembler(inputCols=feature_cols, outputCol="_x").transform(df.dropna(subset=feature_cols).withColumns({c: F.col(c).cast("double") for c in feature_cols}))
    if method == "random_forest":
        trees = RandomForestRegressor(featuresCol="_x", labelCol=target_col, predictionCol="prediction", numTrees=n_estimators, maxDepth=max_depth, featureSubsetStrategy="all", seed=seed)
    else:
        trees = GBTRegressor(featuresCol="_x", labelCol=target_col, predictionCol="prediction", maxIter=n_estimators, maxDepth=max_depth, seed=seed)
    return trees.fit(rows.dropna(subset=[target_col])), rows


def _fit(df: DataFrame, target_col: str, feature_cols: list[str], method: str, folds: int, rest: dict) -> tuple[np.ndarray, float]:
    if method.endswith("_cv"):
        return solve_cv(moments(df, target_col, feature_cols, folds), method.removesuffix("_cv"), **rest)[:2]
    found = moments(df, target_col, feature_cols)
    if not found:
        return np.zeros(len(feature_cols)), math.nan
    return solve(found[0], method, **rest)


def importance(df: DataFrame, target_col: str, feature_cols: list[str], method: str = "lars", n_feat: int | None = None, folds: int = 5, **rest) -> DataFrame:
    """rank, feature, importance: coefficients (lars, ols, lasso, lasso_lars, lasso_lars_ic, ridge, elastic_net, or one of these with _cv) or trees' importances. No rows give no features."""
    if method in TREES:
        values = fit_trees(df, target_col, feature_cols, method, **rest)[0].featureImportances.toArray()
    else:
        values = _fit(df, target_col, feature_cols, method, folds, ({"most": n_feat} | rest) if method == "lars" else rest)[0]
    return df.sparkSession.createDataFrame(ranked(feature_cols, values, n_feat), "rank int, feature string, importance double")


def predict(df: DataFrame, target_col: str, feature_cols: list[str], method: str = "ols", folds: int = 5, output_col: str = "prediction", **rest) -> DataFrame:
    """Adds the fitted value of the target; NULL where a feature is (for trees such rows are left out)."""
    if method in TREES:
        model, rows = fit_trees(df, target_col, feature_cols, method, **rest)
        return model.transform(rows).drop("_x").withColumnRenamed("prediction", output_col)
    b, b0 = _fit(df, target_col, feature_cols, method, folds, rest)
    fitted = sum((F.col(c) * float(v) for c, v in zip(feature_cols, b, strict=True)), F.lit(float(b0)))
    return df.withColumn(output_col, F.when(~F.isnan(fitted), fitted))


def supervised_components(df: DataFrame, target_col: str, feature_cols: list[str], method: str = "lars", n_feat: int = 30, n_components: int | None = None) -> tuple[DataFrame, list[str]]:
    """Adds PC1.. of the features that `method` selects, standardised; components come from the same moments, scores are column expressions. Gives their names too."""
    m = moments(df, target_col, feature_cols)
    if not m:
        return df, []
    b = _fit(df, target_col, feature_cols, method, 5, {})[0] if method.endswith("_cv") else solve(m[0], method, most=n_feat if method == "lars" else None)[0]
    chosen = [feature_cols.index(n) for _, n, _ in ranked(feature_cols, b, n_feat)]
    mean, cov = m[0].mean[chosen], m[0].cov[np.ix_(chosen, chosen)]
    sd = np.sqrt(np.diag(cov))
    v = np.linalg.eigh(cov / np.outer(sd, sd))[1][:, ::-1][:, :n_components] if chosen else np.zeros((0, 0))
    v = v * np.where(v.sum(0) < 0, -1.0, 1.0)
    names = [f"PC{i + 1}" for i in range(v.shape[1])]
    z = [(F.col(feature_cols[j]) - float(mean[i])) / float(sd[i]) for i, j in enumerate(chosen)]
    return df.withColumns({n: sum((x * float(v[i, p]) for i, x in enumerate(z)), F.lit(0.0)) for p, n in enumerate(names)}), names


def supervised_pca(df: DataFrame, target_col: str, feature_cols: list[str], method: str = "lars", n_feat: int = 30, n_components: int | None = None, lags: int = 0, target_lookahead: int = 1, regression: str = "lasso_lars_ic", output_col: str = "prediction") -> DataFrame:
    """Adds components of the selected features, and the target ahead as fitted from them, the target and their lags."""
    ahead = f"{target_col}_F{target_lookahead}"
    led = df.withColumn(ahead, F.lead(target_col, target_lookahead).over(by_ticker()) if target_lookahead else F.col(target_col))
    led, names = supervised_components(led, ahead, feature_cols, method, n_feat, n_components)
    made, ahead, predictors = prepare(led.drop(ahead), target_col, names, target_lookahead, lags)
    return predict(made, ahead, predictors, regression, output_col=output_col).drop(*[p for p in predictors if p not in (target_col, *names)])


def windowed_predict(df: DataFrame, target_col: str, feature_cols: list[str], method: str = "lasso_lars_ic", window_size: int = 120, expanding: bool = False, every: int = 1, target_lookahead: int = 1, feature_lags: int = 0, n_feat: int | None = None, n_components: int | None = None) -> DataFrame:
    """date, ticker, prediction of the target `target_lookahead` rows on, refitted at every n-th row on the rows before whose target is known by then.

    With n_feat, features are first selected by least angles and turned into components, within each window. A ticker is one kernel.
    """
    made, ahead, predictors = prepare(df, target_col, feature_cols, target_lookahead, feature_lags)

    def fit(x: np.ndarray, y: np.ndarray):
        m = of_rows(x, y)
        if n_feat is None:
            return solve(m, method)
        chosen = [int(n) for _, n, _ in ranked([str(i) for i in range(x.shape[1])], solve(m, "lars", most=n_feat)[0], n_feat)]
        mean, sd = m.mean[chosen], np.sqrt(np.diag(m.cov)[chosen])
        turn = np.zeros((x.shape[1], len(chosen)))
        turn[chosen] = np.linalg.eigh(m.cov[np.ix_(chosen, chosen)] / np.outer(sd, sd))[1][:, ::-1] / sd[:, None]
        turn = turn[:, :n_components]
        b, b0 = solve(of_rows((x[:, chosen] - mean) @ turn[chosen], y), method)
        return turn @ b, b0 - mean @ turn[chosen] @ b

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        x, y = pdf[predictors].to_numpy("float64"), pdf[ahead].to_numpy("float64")
        out, found = [], None
        for i in range(window_size + target_lookahead - 1, len(x)):
            end = i - target_lookahead + 1  # targets of rows before are known at row i
            if (end - window_size) % every == 0:
                at = np.arange(0 if expanding else end - window_size, end)
                at = at[np.isfinite(x[at]).all(1) & np.isfinite(y[at])]
                found = fit(x[at], y[at]) if len(at) > x.shape[1] + 1 else None
            if found is not None and np.isfinite(x[i]).all():
                out.append((pdf[DATE].iloc[i], pdf[TICKER].iloc[i], x[i] @ found[0] + found[1]))
        return pd.DataFrame(out, columns=["date", "ticker", "prediction"])

    return made.select(DATE, TICKER, ahead, *predictors).groupBy(TICKER).applyInPandas(run, "date date, ticker string, prediction double")


def fit_scores(df: DataFrame, actual_col: str, predicted_col: str = "prediction", n_features: int = 1) -> DataFrame:
    """One row: mse, rmse, mae, r2, adj_r2, and the share of rows where both change in the same direction from the row before, of rows with both values."""
    rows = df.select(DATE, TICKER, F.col(actual_col).cast("double").alias("a"), F.col(predicted_col).cast("double").alias("p")).dropna()
    rows = rows.withColumns({"da": F.col("a") - F.lag("a").over(by_ticker()), "dp": F.col("p") - F.lag("p").over(by_ticker())})
    e, n = F.col("a") - F.col("p"), F.count(F.lit(1))
    one = rows.agg(
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.avg(e * e) / F.nullif(F.var_pop("a"), F.lit(0.0))).alias("r2"),
        n.alias("n"), F.avg((F.signum("da") == F.signum("dp")).cast("double")).alias("chg_accuracy"),
    )
    return one.select("mse", "rmse", "mae", "r2", F.when(F.col("n") > n_features + 1, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - n_features - 1)).alias("adj_r2"), "chg_accuracy")


def ranks(df: DataFrame, value_col: str, output_col: str, parts: int = 64) -> DataFrame:
    """Adds the average rank over the whole table; NULL stays NULL.

    Values are counted first, so a frequent one is one row, and dealt by quantiles: no task orders all of them. The ranks go back by an equi-join on values.
    """
    x = F.col(value_col).cast("double")
    cuts = df.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 10000).alias("q"))
    counts = df.filter(x.isNotNull()).groupBy(x.alias("_v")).agg(F.count(F.lit(1)).alias("_c")).join(F.broadcast(cuts), F.lit(True))
    counts = counts.select("_v", "_c", F.size(F.filter("q", lambda b: b < F.col("_v"))).alias("_p"))
    sizes = counts.groupBy("_p").agg(F.sum("_c").alias("_s"))  # at most `parts` rows
    before = sizes.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_b"))
    upto = F.sum("_c").over(Window.partitionBy("_p").orderBy("_v"))
    placed = counts.withColumn("_u", upto).join(F.broadcast(before), "_p").select("_v", (F.col("_b") + F.col("_u") - (F.col("_c") - 1) / 2).alias(output_col))
    return df.join(placed, x == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, target_col: str, feature_cols: list[str]) -> DataFrame:
    """feature, n, spearman_rank, p_val of each feature with the target, over the rows that have both."""
    def p_value(batches):
        for b in batches:
            r, n = b["spearman_rank"].to_numpy("float64"), b["n"].to_numpy("float64")
            t = [x * math.sqrt(max(k - 2, 0) / (1 - x * x)) if abs(x) < 1 else math.copysign(math.inf, x) if x == x else math.nan for x, k in zip(r, n, strict=True)]
            yield b.assign(p_val=[regress.two_sided_t(x, k - 2) if k > 2 else math.nan for x, k in zip(t, n, strict=True)])

    out = None
    for c in feature_cols:
        both = df.select(F.col(c).cast("double").alias("_x"), F.col(target_col).cast("double").alias("_y")).dropna()
        one = ranks(ranks(both, "_x", "_rx"), "_y", "_ry").agg(F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("spearman_rank"))
        out = one if out is None else out.unionByName(one)
    return out.mapInPandas(p_value, "feature string, n long, spearman_rank double, p_val double")


def kendall(df: DataFrame, target_col: str, feature_col: str, parts: int = 32) -> DataFrame:
    """One row (feature, n, kendall_tau): tau-b over the whole table, exact, without a pair of rows made.

    Both columns are cut at quantiles. Pairs of points within one stretch of a column are counted by a kernel each (those within a cell of both are
    taken off once), pairs that differ in both stretches from the numbers of rows in the cells.
    """
    x, y = F.col(feature_col).cast("double"), F.col(target_col).cast("double")
    some = df.select(x.alias("x"), y.alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    q = [i / parts for i in range(1, parts)]
    cuts = some.agg(F.percentile_approx("x", q, 10000).alias("qx"), F.percentile_approx("y", q, 10000).alias("qy"))
    place = lambda of, v: F.size(F.filter(of, lambda b: b < F.col(v)))
    some = some.join(F.broadcast(cuts), F.lit(True)).select("x", "y", "w", place("qx", "x").alias("i"), place("qy", "y").alias("j"))
    schema = "s double"
    run = lambda pdf: pd.DataFrame({"s": [sorts.concordance(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())]})
    inside = some.groupBy("i").applyInPandas(run, schema).unionByName(some.groupBy("j").applyInPandas(run, schema)).unionByName(some.groupBy("i", "j").applyInPandas(run, schema).select((-F.col("s")).alias("s")))
    cells = some.groupBy("i", "j").agg(F.sum("w").alias("w"))  # at most parts x parts rows

    def far(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [sorts.concordance(pdf["i"].to_numpy("float64"), pdf["j"].to_numpy("float64"), pdf["w"].to_numpy())]})

    alike = inside.unionByName(cells.groupBy(F.lit(1).alias("_k")).applyInPandas(lambda pdf: far(pdf), schema)).agg(F.sum("s").alias("s"))
    n = some.agg(F.sum("w").alias("n"))
    tied = lambda c, name: some.groupBy(c).agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * (F.col("w") - 1) / 2).alias(name))
    one = alike.join(n, F.lit(True)).join(tied("x", "tx"), F.lit(True)).join(tied("y", "ty"), F.lit(True))  # single rows
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return one.select(F.lit(feature_col).alias("feature"), F.col("n").cast("long").alias("n"), (F.col("s") / F.nullif(F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty"))), F.lit(0.0))).alias("kendall_tau"))


def filter_scores(df: DataFrame, target_col: str, feature_cols: list[str], method: str = "spearman_rank") -> DataFrame:
    """feature and its statistic with the target: spearman_rank (with p_val), kendall_tau; of binned columns cramers_v, tschuprow_t, pearson_c, chi2, mutual_information."""
    if method == "spearman_rank":
        return spearman(df, target_col, feature_cols)
    one = lambda c: kendall(df, target_col, c) if method == "kendall_tau" else sorts.contingency(df, c, target_col).select(F.lit(c).alias("feature"), method)
    out = one(feature_cols[0])
    for c in feature_cols[1:]:
        out = out.unionByName(one(c))
    return out
