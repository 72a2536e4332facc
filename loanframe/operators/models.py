"""Linear classifiers (M1-M7, M12, M22) and the shared scoring form.

Every fitted model here is linear: ``score = w . x + b`` over the feature
array, with an optional logistic link for probabilities.  Scoring is one
projection over the array, of any width.
Fitting uses proximal Newton steps or sufficient statistics from the Gram
primitive X2 with a p x p solve on the driver.  Cross-validation moves the
models of all folds in lockstep.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanframe.functions.cells import grams
from loanframe.functions.gram import Expand, Interactions, centered, dot, gram_by_group, partition_sums, quadratic
from loanframe.functions.ordering import global_rank

FEATURES, LABEL, KEY = "features", "label", "key"


@dataclass
class LinearScorer:
    """A fitted linear classifier (M22 scoring)."""
    name: str
    w: np.ndarray
    b: float
    link: str = "none"          # "logit": probabilities by the sigmoid; "const": fixed prob
    const_prob: float | None = None
    info: dict = field(default_factory=dict)

    def score_expr(self, features: str = FEATURES, expand: Interactions | None = None) -> Column:
        """The score of an array of features or, with ``expand``, of the columns these are made of: scaling and
        products are folded into the weights, and a row is read as it is stored."""
        if expand is None or not len(self.w):
            return dot(F.col(features), self.w, self.b)
        return quadratic(F.col(features), *expand.form(self.w, self.b))

    def score(self, df: DataFrame, model: str | None = None, features: str = FEATURES,
              label: str = LABEL, key: str = KEY, expand: Interactions | None = None) -> DataFrame:
        """Score table: (model, key, label, score, prob, prediction)."""
        s = self.score_expr(features, expand)
        d = df.select(F.lit(model or self.name).alias("model"), F.col(key).alias("key"),
                      F.col(label).cast("int").alias("label"), s.alias("score"))
        if self.link == "logit":
            prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
        elif self.link == "const":
            prob = F.lit(float(self.const_prob))
        else:
            prob = F.lit(None).cast("double")
        pred = (F.col("score") > 0).cast("int")
        return d.withColumn("prob", prob).withColumn("prediction", pred)


# ----------------------------------------------------------------- helpers

def class_weights(df: DataFrame, label: str = LABEL) -> dict[int, float]:
    """Balanced weights n / (k * n_c) from one grouped count."""
    rows = df.groupBy(label).count().collect()
    n, k = sum(r["count"] for r in rows), len(rows)
    return {int(r[label]): n / (k * r["count"]) for r in rows}


def with_weights(df: DataFrame, weights: dict[int, float] | None, label: str = LABEL,
                 out: str = "weight") -> DataFrame:
    if not weights:
        return df.withColumn(out, F.lit(1.0))
    e = F.lit(1.0)
    for c, w in weights.items():
        e = F.when(F.col(label) == c, F.lit(float(w))).otherwise(e)
    return df.withColumn(out, e)


def stratified_folds(df: DataFrame, k: int, label: str = LABEL, key: str = KEY,
                     seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified k-fold column.  Rows of each class are ranked by a hash
    of the key (distributed rank X1, no single-task window) and dealt out
    round robin, so fold sizes per class differ by at most one."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    d = df.withColumn("_h", h)
    r = global_rank(d, "_h", group=label)
    return r.withColumn(out, ((F.col("rank") - 1) % k).cast("int")).drop("_h", "rank")


# ----------------------------------------------------------------- M1

def fit_dummy(train: DataFrame, label: str = LABEL) -> LinearScorer:
    """M1: most frequent class; probability 1 for it (0 for the other)."""
    rows = train.groupBy(label).count().collect()
    top = sorted(rows, key=lambda r: (-r["count"], r[label]))[0][label]
    return LinearScorer("DummyClassifier", np.zeros(0), 1.0 if int(top) == 1 else -1.0,
                        link="const", const_prob=1.0 if int(top) == 1 else 0.0)


# ----------------------------------------------------------------- M2-M5

def fit_logistic(train: DataFrame, C: float = 1.0, l1_ratio: float = 0.0, weight: str | None = None,
                 max_iter: int = 100, tol: float = 1e-6, features: str = FEATURES, label: str = LABEL,
                 name: str = "LogisticRegression", beta0: np.ndarray | None = None,
                 expand: Interactions | None = None) -> LinearScorer:
    """Penalised logistic regression, objective
    C * sum_i w_i loss_i + (1 - r) / 2 |beta|^2 + r |beta|_1 (intercept free), by proximal Newton, one pass per
    step, at any number of features p (a pass adds vectors of p^2 / 2 numbers)."""
    from loanframe.functions import newton
    w, b, info = newton.fit(train, features, label, "logistic", weight, C=C, l1=float(l1_ratio), l2=1.0 - float(l1_ratio),
                            max_iter=max_iter, tol=tol, beta0=beta0, expand=expand)
    return LinearScorer(name, w, b, link="logit", info={"C": C, "l1_ratio": l1_ratio, **info})


def _width(df: DataFrame, features: str = FEATURES) -> int:
    r = df.select(F.size(features).alias("p")).first()
    return int(r["p"]) if r is not None else 0


def score_many(df: DataFrame, scorers: dict[str, "LinearScorer"], features: str = FEATURES,
               label: str = LABEL, key: str = KEY, fold: str | None = None,
               expand: Interactions | None = None) -> DataFrame:
    """Score table of many linear models in ONE pass (numpy dot products on
    Arrow batches; with ``expand`` of the features made of the array column).  With ``fold``, scorer names ``"<name>@<m>"`` only score
    rows of fold m (held-out scoring for CV)."""
    import pandas as pd
    from loanframe.functions.gram import matrix
    items = [(n, s.w.astype(float), float(s.b), s.link, s.const_prob) for n, s in scorers.items()]
    cols = [features, label, key] + ([fold] if fold else [])

    def part(it):
        for pdf in it:
            if pdf.empty:
                continue
            x = matrix(pdf, features) if any(len(it[1]) for it in items) else np.zeros((len(pdf), 0))
            x = expand(x) if expand and x.shape[1] else x
            y = pdf[label].to_numpy().astype(int)
            k = pdf[key].to_numpy()
            fo = pdf[fold].to_numpy() if fold else None
            out = []
            for n, w, b, link, cp in items:
                m = np.ones(len(pdf), dtype=bool)
                if fold is not None and "@" in n:
                    m = fo == int(n.rsplit("@", 1)[1])
                if not m.any():
                    continue
                sc = (x[m] @ w if len(w) else np.zeros(m.sum())) + b
                if link == "logit":
                    pr = 1.0 / (1.0 + np.exp(-sc))
                elif link == "const":
                    pr = np.full(len(sc), float(cp))
                else:
                    pr = np.full(len(sc), np.nan)
                out.append(pd.DataFrame({"model": n, "key": k[m], "label": y[m], "score": sc,
                                         "prob": pr, "prediction": (sc > 0).astype(int)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    schema = "model string, key bigint, label int, score double, prob double, prediction int"
    out = df.select(*cols).mapInPandas(part, schema)
    return out.withColumn("prob", F.when(~F.isnan("prob"), F.col("prob")))


def cv_rows(train: DataFrame, cv: int = 5, folds_col: str | None = None, features: str = FEATURES,
            expand: Interactions | None = None):
    """The labelled rows as stored cells with their folds: what every pass of ``fit_logistic_cv`` reads."""
    from loanframe.functions.cells import cell_rows, stored
    rows = cell_rows(train.where(F.col(LABEL).isNotNull()), features, [LABEL, folds_col or KEY], expand)
    folded = rows.df if folds_col else stratified_folds(rows.df, cv)
    return stored(rows.of(folded.withColumn("outer", F.lit(0)).drop(*([] if folds_col else [KEY]))))


def fit_logistic_cv(train: DataFrame, penalty: str = "l2", Cs: list[float] | int = 10, cv: int = 5,
                    l1_ratio: float = 0.5, weights: dict[int, float] | None = None,
                    scoring: str = "accuracy", max_iter: int = 100,
                    name: str = "LogisticRegressionCV", folds_col: str | None = None, features: str = FEATURES,
                    expand: Interactions | None = None, keep: np.ndarray | None = None, rows=None) -> LinearScorer:
    """M2-M4: logistic regression with C chosen by stratified k-fold CV
    (mean held-out score: accuracy by default, or roc_auc), then refit on
    all train rows with the best C.  The models of all folds move in lockstep
    along the path of C, each from its last solution, until they have converged
    (``info["converged"]`` says whether all did within ``max_iter`` steps).
    ``keep``: the features that may be used (the weights of the others are zero).  ``rows``: those of ``cv_rows``, if
    they are stored."""
    from loanframe.functions.lockstep import Fit, fit_together, held_out_hits, held_out_runs
    from loanframe.operators.metrics import roc_auc_of_runs
    if isinstance(Cs, int):
        Cs = [float(v) for v in np.logspace(-4, 4, Cs)]
    ratio = {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio}[penalty]
    w = (weights or {}).get(0, 1.0), (weights or {}).get(1, 1.0)
    fold = folds_col or "fold"
    d = rows or cv_rows(train, cv, folds_col, features, expand)
    p = d.cells.width() - 1
    fits: dict[float, list[Fit]] = {}
    last = [None] * cv
    for c in sorted(Cs):
        fits[c] = fit_together(d, [Fit(None, fold, m, c, ratio, 1.0 - ratio, w, keep=keep, beta=last[m]) for m in range(cv)],
                               p, max_iter=max_iter)
        last = [f.beta for f in fits[c]]
    flat = [f for c in Cs for f in fits[c]]
    if scoring == "roc_auc":
        got = roc_auc_of_runs(held_out_runs(d, flat))
    else:
        got = dict(enumerate(held_out_hits(d, flat)))
    values = np.array([got.get(i, np.nan) for i in range(len(flat))])
    means = dict(zip(Cs, values.reshape(len(Cs), cv).mean(axis=1).tolist(), strict=True))
    best_c = max(Cs, key=lambda c: (means[c] if means[c] == means[c] else -np.inf, -Cs.index(c)))
    best = fit_together(d, [Fit(None, None, None, best_c, ratio, 1.0 - ratio, w, keep=keep, beta=fits[best_c][0].beta)], p,
                        max_iter=max_iter, tol=1e-7)[0]
    return LinearScorer(name, best.beta[:-1], float(best.beta[-1]), link="logit", info={
        "Cs": Cs, "cv_scores": [means[c] for c in Cs], "best_C": best_c, "penalty": penalty,
        "converged": bool(best.converged and all(f.converged for f in flat))})


# ----------------------------------------------------------------- M6 / M7

def _ridge_solve(g: dict, alpha: float) -> tuple[np.ndarray, float]:
    mx, cxx, cxy, _, my = centered(g)
    p = len(mx)
    w = np.linalg.solve(cxx + alpha * np.eye(p), cxy)
    return w, float(my - mx @ w)


def _pm(train: DataFrame, label: str) -> DataFrame:
    return train.withColumn("_pm", F.col(label).cast("double") * 2.0 - 1.0)


def fit_ridge(train: DataFrame, alpha: float = 1.0, features: str = FEATURES, label: str = LABEL,
              expand: Interactions | None = None) -> LinearScorer:
    """M6: ridge regression of the +-1 label; sign is the class, the
    distance is the decision score.  One Gram pass, p x p solve."""
    g = gram_by_group(_pm(train, label), features, "_pm", expand=expand, p=expand.width() if expand else None)[None]
    w, b = _ridge_solve(g, alpha)
    return LinearScorer("RidgeClassifier", w, b, info={"alpha": alpha})


def fit_ridge_cv(train: DataFrame, alphas: list[float] | None = None, features: str = FEATURES,
                 label: str = LABEL, expand: Expand | None = None, p: int | None = None) -> LinearScorer:
    """M7: ridge classifier with alpha from 13 log-spaced values, chosen by the
    exact leave-one-out squared error of the +-1 label.

    Two passes for any number of alphas.  The first gives the Gram matrix and
    its eigenvectors V with values l.  A row's leverage under alpha is
    h = 1 / n + sum_j (v_j . x)^2 / (l_j + alpha) with centred x, its fitted
    value uses the same products, and its error without itself is
    (y - fit) / (1 - h): the second pass sums the squares for all alphas.
    """
    alphas = alphas or [float(v) for v in np.logspace(-6, 6, 13)]
    d = _pm(train, label).select(features, "_pm")
    g = gram_by_group(d, features, "_pm", expand=expand, p=p)[None]
    mx, cxx, cxy, _, my = centered(g)
    values, vectors = np.linalg.eigh(cxx)
    values, n = np.maximum(values, 0.0), g["sw"]
    inverse = 1.0 / (values[:, None] + np.array(alphas)[None, :])
    target = (vectors.T @ cxy)[:, None] * inverse

    def errors(b) -> np.ndarray:
        x = b.matrix(features)
        z = ((expand(x) if expand else x) - mx) @ vectors
        h = 1.0 / n + (z * z) @ inverse
        left = b["_pm"].to_numpy(dtype=float)[:, None] - my - z @ target
        # a row whose leverage is 1 is fitted whatever its label: its error without itself can't be told, and is 0 / 0
        return np.sum((left / np.maximum(1.0 - h, 1e-12)) ** 2, axis=0)

    mse = (partition_sums(d, errors, len(alphas)) / n).tolist()
    best = int(np.argmin(mse))
    w, b = _ridge_solve(g, alphas[best])
    return LinearScorer("RidgeClassifierCV", w, b, info={"alphas": alphas, "cv_mse": mse, "best_alpha": alphas[best]})


# ----------------------------------------------------------------- M12

def fit_lda(train: DataFrame, features: str = FEATURES, label: str = LABEL,
            expand: Interactions | None = None) -> LinearScorer:
    """Linear discriminant analysis from per-class Grams: class means,
    pooled within-class covariance, weights by pseudo-inverse; probabilities
    by the logistic link of the discriminant."""
    gs = grams(train, features, label, expand)
    (n0, s0, x0), (n1, s1, x1) = gs[0], gs[1]
    m0, m1 = s0 / n0, s1 / n1
    s = (x0 - n0 * np.outer(m0, m0)) + (x1 - n1 * np.outer(m1, m1))
    cov = s / max(n0 + n1 - 2, 1)                        # the pooled estimate
    inv = np.linalg.pinv(cov, rcond=1e-10, hermitian=True)
    w = inv @ (m1 - m0)
    b = -0.5 * (m1 + m0) @ w + math.log(n1 / n0)
    return LinearScorer("LinearDiscriminantAnalysis", w, float(b), link="logit")
