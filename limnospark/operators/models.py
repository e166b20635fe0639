"""Models as Spark jobs.

Every fit is distributed; the driver only loops over small grids (folds x
targets x configurations). Predictions stay DataFrames and are scored with the
E1 aggregate. Linear models come from sums of products; forests
and the bases of M10 are in :mod:`.forests`, boosting and extremely randomised
trees in :mod:`.trees`, k-means in :mod:`.kmeans`, kriging in :mod:`.kriging`.
"""

from __future__ import annotations

import random
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .evaluate import fold_scores
from .forests import How, Histograms, fit, predicted
from .ranking import quantiles
from .trees import Model

FEATURES = "features"


def assembler(cols: list[str], out: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def extra_trees(n: int = 20, depth: int = 6, min_leaf: int = 1, seed: int = 42) -> Histograms:
    """M10's 'ET': no row draws, square root of the features per node, best
    cuts (drawn cuts are in :mod:`.trees`)."""
    return Histograms(How(n, depth, False, "sqrt", seed, min_leaf=min_leaf))


def random_forest(n: int = 20, depth: int = 6, seed: int = 42) -> Histograms:
    """M4 'RF'."""
    return Histograms(How(n, depth, seed=seed))


def gbt(iters: int = 30, depth: int = 4, step: float = 0.1, seed: int = 42) -> Histograms:
    """M10's gradient boosting."""
    return Histograms(How(iters, depth, False, "all", seed, step))


def elastic_net(reg: float, l1_ratio: float) -> LinearRegression:
    """M7: lasso / elastic net."""
    return LinearRegression(regParam=reg, elasticNetParam=l1_ratio, featuresCol=FEATURES)


def missing(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns that hold NULL or NaN anywhere: those a fitted pipeline has to
    impute."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    found = df.agg(*[F.max(bad(c)).alias(c) for c in cols]).first()
    return [c for c in cols if found[c]]


def stages(feats: list[str], gaps: list[str], est) -> list:
    """Median imputation (of the rows the pipeline is fitted on), assembly,
    model."""
    filled = {c: f"_filled_{c}" for c in gaps}
    feats = [filled.get(c, c) for c in feats]
    last = [est.on(feats)] if isinstance(est, Histograms) else [assembler(feats), est]
    return [*([_fill(gaps, list(filled.values()))] if gaps else []), *last]


def _fill(gaps: list[str], outs: list[str]) -> Imputer:
    return Imputer(strategy="median", relativeError=1e-4, inputCols=gaps, outputCols=outs)


def fit_predict(train: DataFrame, test: DataFrame, feats: list[str], label: str, est, out: str = "pred", gaps: list[str] | None = None):
    """Fit imputation, assembly and ``est`` on train, predict test; returns
    (model, test with ``out``). ``gaps``: the columns to impute, looked up
    in ``train`` if not given."""
    est = est.copy()
    est.setLabelCol(label)
    est.setPredictionCol(out)
    gaps = missing(train, feats) if gaps is None else gaps
    model = Pipeline(stages=stages(feats, gaps, est)).fit(train)
    return model, model.transform(test).drop(FEATURES, *[f"_filled_{c}" for c in gaps])


def cv_predictions(df: DataFrame, feats: list[str], label: str, fold: str, folds: list[int], est, key: list[str],
                   out: str = "pred") -> DataFrame:
    """Out-of-fold predictions: for each fold, fit on the other folds and
    predict the held-out fold. Forests of all folds grow in the same passes;
    other models are fitted side by side (each fit is a distributed job), and
    without gaps their features are assembled once for all."""
    if isinstance(est, Histograms):
        return own_folds(df, feats, fold, folds, {out: (est, label)}).select(*key, fold, label, out)
    gaps = missing(df, feats)
    if not gaps:
        df = materialize(assembler(feats).transform(df).select(*key, fold, label, FEATURES), "assembled")

    def one(i):
        train, test = df.where(F.col(fold) != i), df.where(F.col(fold) == i)
        if gaps:
            return fit_predict(train, test, feats, label, est, out, gaps)[1].select(*key, fold, label, out)
        e = est.copy()
        e.setLabelCol(label)
        e.setPredictionCol(out)
        return e.fit(train).transform(test).select(*key, fold, label, out)

    with ThreadPool(len(folds)) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(one), folds)
    return reduce(lambda a, b: a.unionByName(b), parts)


def fold_fits(df: DataFrame, feats: list[str], fold: str, folds: list[int], fits: dict[str, tuple[Histograms, str | dict]]):
    """Forests of all folds and of all ``fits`` (name -> estimator, label or a
    label per fold) in the same passes: (``df`` with the columns they read, those columns, the
    groves). A fold's model has medians of its training rows for gaps, in
    columns of its own."""
    gaps = missing(df, feats)
    cols, own = [c for c in feats if c not in gaps], {}
    for f in folds if gaps else []:
        df = _fill(gaps, [f"_filled{f}_{c}" for c in gaps]).fit(df.where(F.col(fold) != f)).transform(df)
        own[f] = {c: f"_filled{f}_{c}" for c in gaps}
        cols += own[f].values()
    fits = {c: (est, y if isinstance(y, dict) else dict.fromkeys(folds, y)) for c, (est, y) in fits.items()}
    labels = list(dict.fromkeys(y[f] for _, y in fits.values() for f in folds))
    at = lambda f: tuple(cols.index(own.get(f, {}).get(c, c)) for c in feats)
    groves = fit(df, cols, labels, fold, [(est.how, [Model(labels.index(y[f]), f, at(f)) for f in folds]) for est, y in fits.values()])
    return df, cols, dict(zip(fits, groves))


def own_folds(df: DataFrame, feats: list[str], fold: str, folds: list[int], fits: dict[str, tuple[Histograms, str]]) -> DataFrame:
    """``df`` with a column per fit: the prediction of the model that does
    not see the row's fold. ``folds`` count from 0."""
    got, cols, groves = fold_fits(df, feats, fold, folds, fits)
    return got.select(*df.columns, *[predicted(g, cols, folds, fold).alias(c) for c, g in groves.items()])


# --------------------------------------------------------------------------
# Linear models from sums of products (M7, M14, M19): one pass for all folds
# --------------------------------------------------------------------------

def origin(df: DataFrame, cols: list[str]) -> list[float]:
    """The columns' means: sums of products about them keep their digits
    where values are large and close together."""
    row = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [row[f"m{i}"] or 0.0 for i in range(len(cols))]


def gram_by_fold(df: DataFrame, feats: list[str], label: str, fold: str | None = None, about: list[float] | None = None) -> dict:
    """fold -> matrix of sums of products of (1, features, label), from one
    aggregate; values are taken as distances from ``about`` (features, label).
    Rows with a missing value in any of them do not count."""
    about = about or [0.0] * (len(feats) + 1)
    cols = [F.lit(1.0), *[F.col(c).cast("double") - a for c, a in zip([*feats, label], about)]]
    whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in [*feats, label]]))
    names = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = whole.groupBy(F.col(fold).alias("f") if fold else F.lit(0).alias("f")).agg(
        *[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in names]).collect()
    out = {}
    for row in sums:
        g = np.zeros((len(cols), len(cols)))
        for i, j in names:
            g[i, j] = g[j, i] = row[f"s{i}_{j}"]
        out[row["f"]] = g
    return out


def centred(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """n, means, and the centred products of features and label."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    return n, mean, g[1:-1, 1:-1] - n * np.outer(mean[:-1], mean[:-1]), g[1:-1, -1] - n * mean[:-1] * mean[-1]


def ridge_fit(g: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of ``sum (y - b - w x)^2 + alpha |w|^2``."""
    _, mean, xx, xy = centred(g)
    w = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    return w, float(mean[-1] - w @ mean[:-1])


def elastic_net_fit(g: np.ndarray, lam: float, l1_ratio: float, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and intercept of ``sum (y - b - w x)^2 / 2n + lam (l1_ratio |w|
    + (1 - l1_ratio) / 2 w^2)`` over features scaled to unit deviation, by
    coordinate descent on the products."""
    n, mean, xx, xy = centred(g)
    dev = np.sqrt(np.maximum(np.diag(xx) / n, 1e-300))
    c, r = xx / n / np.outer(dev, dev), xy / n / dev
    w = np.zeros(len(r))
    for _ in range(rounds):
        last = w.copy()
        for k in range(len(w)):
            z = r[k] - c[k] @ w + c[k, k] * w[k]
            w[k] = np.sign(z) * max(abs(z) - lam * l1_ratio, 0.0) / (c[k, k] + lam * (1 - l1_ratio))
        if np.abs(w - last).max(initial=0.0) <= 1e-12 * max(1.0, np.abs(w).max(initial=0.0)):
            break
    w = w / dev
    return w, float(mean[-1] - w @ mean[:-1])


def squared_error(g: np.ndarray, w: np.ndarray, b: float) -> float:
    """Sum of squared errors of a linear model on the rows behind ``g``."""
    v = np.concatenate([[b], w, [-1.0]])
    return float(v @ g @ v)


def choose_penalty(grams: list[np.ndarray], fit, penalties: list[float]) -> float:
    """The penalty with the least error over left-out folds, all from the
    folds' sums (the first of equals)."""
    total = sum(grams)
    cost = [sum(squared_error(g, *fit(total - g, p)) for g in grams) for p in penalties]
    return penalties[int(np.argmin(cost))]


def linear_expression(feats: list[str], w: np.ndarray, b: float):
    return reduce(lambda a, c: a + c, [F.col(f).cast("double") * float(x) for f, x in zip(feats, w)], F.lit(float(b)))


def at_origin(w: np.ndarray, b: float, about: list[float]) -> tuple[np.ndarray, float]:
    """Weights and intercept for the columns themselves."""
    return w, float(b + about[-1] - w @ np.array(about[:-1]))


def fit_linear(df: DataFrame, feats: list[str], label: str, fit) -> tuple[np.ndarray, float]:
    """Weights and intercept by ``fit`` (a function of the sums)."""
    about = origin(df, [*feats, label])
    return at_origin(*fit(sum(gram_by_fold(df, feats, label, about=about).values())), about)


def linear_cv_predictions(df: DataFrame, feats: list[str], label: str, fold: str, key: list[str], models: dict) -> DataFrame:
    """Out-of-fold predictions of several linear models, a column each.
    ``models``: name -> function of the training folds' sums (a list) giving
    weights and intercept. One aggregate (after one for the means) fits all
    folds: a fold's training sums are the total less its own."""
    about = origin(df, [*feats, label])
    grams = gram_by_fold(df, feats, label, fold, about)
    cols = []
    for name, fit in models.items():
        pred = F.lit(None).cast("double")
        for f in sorted(grams):
            w, b = at_origin(*fit([grams[k] for k in sorted(grams) if k != f]), about)
            pred = F.when(F.col(fold) == f, linear_expression(feats, w, b)).otherwise(pred)
        cols.append(pred.alias(name))
    return df.select(*key, fold, label, *cols)


def ridge(alpha: float):
    """For :func:`linear_cv_predictions`: a fixed penalty."""
    return lambda grams: ridge_fit(sum(grams), alpha)


def ridge_cv(alphas=(0.1, 1.0, 10.0, 100.0)):
    """The penalty chosen by the inner folds."""
    return lambda grams: ridge_fit(sum(grams), choose_penalty(grams, ridge_fit, list(alphas)))


def lasso_cv(lams=(0.001, 0.01, 0.1, 1.0)):
    fit = lambda g, lam: elastic_net_fit(g, lam, 1.0)
    return lambda grams: fit(sum(grams), choose_penalty(grams, fit, list(lams)))


def scaled_elastic_net(lam: float, l1_ratio: float):
    return lambda grams: elastic_net_fit(sum(grams), lam, l1_ratio)


def cv_scores(df, feats, label, fold, folds, est, key) -> DataFrame:
    """M20 building block: fold R2 / RMSE of out-of-fold predictions."""
    return fold_scores(cv_predictions(df, feats, label, fold, folds, est, key), label, "pred", fold)


def mean_ensemble(cols: list[str], weights: list[float] | None = None):
    """M9: (weighted) mean of prediction columns."""
    weights = weights or [1.0] * len(cols)
    return sum(F.col(c) * w for c, w in zip(cols, weights)) / float(sum(weights))


def importances(imp: list[float], feats: list[str], target: str, top: int, spark) -> DataFrame:
    """Feature importances -> (target, feature, importance, rank)."""
    rows = sorted(zip(feats, imp), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame([(target, f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                 "target string, feature string, importance double, rank int")


def coefficients(weights, feats: list[str], spark) -> DataFrame:
    """Linear coefficients sorted by absolute value."""
    rows = sorted(zip(feats, weights), key=lambda x: (-abs(x[1]), x[0]))
    return spark.createDataFrame([(f, float(c)) for f, c in rows], "feature string, coef double")


def two_stage(train: DataFrame, test: DataFrame, feats: list[str], label: str, q_value_col: str, classifier=None,
              winsor: tuple[float, float] = (0.01, 0.99)):
    """P(high) classifier (label >= train quantile, given as a column)
    -> probability as an extra feature -> regressor on the label clipped to
    its train quantiles ``winsor``; r = max(regression, 0) and the result
    max(0.6 * r + 0.4 * p * r, 0). The classifier is a logistic regression
    (one distributed L-BFGS fit); ``classifier`` may pass a GBTClassifier."""
    tr = train.withColumn("_hi", (F.col(label) >= F.col(q_value_col)).cast("double"))
    gbc = (classifier or LogisticRegression(maxIter=50, labelCol="_hi", featuresCol=FEATURES)).copy()
    gbc.setLabelCol("_hi")
    gaps = missing(train, feats)
    clf = Pipeline(stages=stages(feats, gaps, gbc)).fit(tr)
    outs = [gbc.getProbabilityCol(), gbc.getPredictionCol(), gbc.getRawPredictionCol(), *[f"_filled_{c}" for c in gaps]]

    def with_p(frame):
        return clf.transform(frame).withColumn("p_high", vector_to_array(outs[0])[1]).drop(*outs, FEATURES)

    lims = quantiles(train, label, list(winsor), ["lo", "hi"]).first()  # two numbers
    trp = with_p(tr).withColumn("_w", F.least(F.greatest(F.col(label), F.lit(lims["lo"])), F.lit(lims["hi"])))
    _, pred = fit_predict(trp, with_p(test), feats + ["p_high"], "_w", random_forest(10, 5), "_r", gaps)
    r = F.greatest(F.col("_r"), F.lit(0.0))
    return pred.withColumn("pred", F.greatest(0.6 * r + 0.4 * F.col("p_high") * r, F.lit(0.0))).drop("_r", "_w")


# Support a branch needs for an expert of its own.
GUARD = {"min_rows": 300, "min_fold": 100, "min_groups": 25}


def gated_experts(train: DataFrame, test: DataFrame, feats: list[str], label: str, gate: str, est, fold: str, group: str,
                  guard: dict = GUARD, clip_min: float = 0.0):
    """One expert per gate branch (gate true / false) where the training
    folds support it (:func:`branch_support`: every fold present, rows, rows
    in the thinnest fold, groups); else the global model. Predictions are
    clipped at ``clip_min``; ``route`` names what was used: ``expert_high``,
    ``expert_low``, ``fallback_global_high``, ``fallback_global_low``, or
    ``global`` where the gate is unknown."""
    gaps = missing(train, feats)
    _, out = fit_predict(train, test, feats, label, est, "_pg", gaps)
    folds = sorted(r[fold] for r in train.select(fold).distinct().collect())
    support = {r["branch"]: r["supported"] for r in branch_support(
        train.where(F.col(gate).isNotNull()), gate, fold, group, folds, **guard).collect()}
    route, pred = F.lit("global"), F.col("_pg")
    for val, name in ((True, "high"), (False, "low")):
        mine = F.col(gate) == val
        if support.get(val):
            m, _ = fit_predict(train.where(mine), train.limit(0), feats, label, est, f"_p_{name}", gaps)
            out = m.transform(out).drop(FEATURES, *[f"_filled_{c}" for c in gaps])
            route, pred = F.when(mine, f"expert_{name}").otherwise(route), F.when(mine, F.col(f"_p_{name}")).otherwise(pred)
        else:
            route = F.when(mine, f"fallback_global_{name}").otherwise(route)
    return out.withColumn("route", route).withColumn("pred", F.greatest(pred, F.lit(clip_min))).drop("_p_high", "_p_low", "_pg")


def branch_support(df: DataFrame, gate: str, fold: str, group: str, folds: int | list[int], min_rows: int, min_fold: int,
                   min_groups: int) -> DataFrame:
    """Per gate branch: rows, distinct groups, rows per fold, the
    smallest fold, and the reasons a branch is refused."""
    folds = list(range(folds)) if isinstance(folds, int) else folds
    g = df.groupBy(F.col(gate).alias("branch")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"),
        *[F.count_if(F.col(fold) == i).alias(f"fold_{i}") for i in folds],
    )
    mn = F.array_min(F.array(*[F.col(f"fold_{i}") for i in folds]))
    reasons = F.concat_ws(
        ";",
        F.when(mn == 0, F.lit("missing_fold")),
        F.when(F.col("n_rows") < min_rows, F.lit("too_few_rows")),
        F.when(mn < min_fold, F.lit("thin_fold")),
        F.when(F.col("n_groups") < min_groups, F.lit("too_few_groups")),
    )
    return g.withColumn("min_fold_rows", mn).withColumn("reasons", reasons).withColumn("supported", reasons == "")


def grid_configs(space: dict[str, list]) -> list[dict]:
    """Every combination of the space's values."""
    out: list[dict] = [{"kind": "grid"}]
    for name, values in space.items():
        out = [c | {name: v} for c in out for v in values]
    return out


def random_configs(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """``n`` configurations, each value drawn by ``seed``; the same seed
    gives the same configurations."""
    draw = random.Random(seed)
    return [{"kind": "random"} | {name: draw.choice(values) for name, values in space.items()} for _ in range(n)]


__all__ = [
    "assembler", "extra_trees", "random_forest", "gbt", "elastic_net", "fit_predict", "cv_predictions", "cv_scores",
    "gram_by_fold", "ridge_fit", "elastic_net_fit", "linear_cv_predictions", "ridge", "ridge_cv", "lasso_cv", "scaled_elastic_net", "mean_ensemble", "importances", "coefficients", "two_stage",
    "gated_experts", "branch_support", "grid_configs", "random_configs", "LogisticRegression",
]
