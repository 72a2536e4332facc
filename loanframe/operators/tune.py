"""Model panel, ranking, feature selection and grid search.

The panel fits every estimator (failures become a row with NULL metrics and
the error text), scores all fitted models on the test rows in ONE pass
(``score_many``) and computes every metric for every model in one grouped
job.  Grid search fixes outer and inner folds once, as columns, and fits the
models of all candidates and folds together (``functions/lockstep.py``); one
exact AUC job (K1) judges them all.
"""

from __future__ import annotations

import threading
import traceback
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.functions.cells import CellRows, blocks, cell_rows, stored
from loanframe.functions.gram import Interactions, tree_sums
from loanframe.functions.lockstep import Fit, fit_together, held_out_runs
from loanframe.operators import metrics as K
from loanframe.operators import models as M
from loanframe.operators.online import Dealt, fit_online
from loanframe.operators.svm import fit_linear_svc
from loanframe.session import shared_table

PANEL_SCHEMA = ("model string, roc_auc double, pr_auc double, log_loss double, brier_score double,"
                " matthews_corrcoef double, error string")


class Once:
    """What ``make`` gives for the first caller's rows, for all of a panel's estimators that read them so."""

    def __init__(self, make: Callable[[DataFrame], object]):
        self.make, self.lock, self.made = make, threading.Lock(), None

    def __call__(self, d: DataFrame):
        with self.lock:
            if self.made is None:
                self.made = self.make(d)
            return self.made


def default_panel(expand: Interactions | None = None, features: str = M.FEATURES,
                  shards: Once | None = None) -> dict[str, Callable[[DataFrame], M.LinearScorer]]:
    """The cited 11 estimators (names keep the class and the variant); ``expand``: the features are made of the array column.
    The estimators of a panel are for one table: those with folds share its cells, the learners share ``shards``."""
    of = {"features": features, "expand": expand}
    cells = Once(lambda d: M.cv_rows(d, **of))
    shards = shards or (lambda _: None)
    return {
        "DummyClassifier": M.fit_dummy,
        "LogisticRegressionCV(l1)": lambda d: M.fit_logistic_cv(d, "l1", rows=cells(d), **of),
        "LogisticRegressionCV(l2)": lambda d: M.fit_logistic_cv(d, "l2", rows=cells(d), **of),
        "LogisticRegressionCV(elasticnet)": lambda d: M.fit_logistic_cv(d, "elasticnet", l1_ratio=0.5, rows=cells(d), **of),
        "RidgeClassifierCV": lambda d: M.fit_ridge_cv(d, p=expand.width() if expand else None, **of),
        "SGDClassifier(log_loss)": lambda d: fit_online(d, "log", dealt=shards(d), **of),
        "SGDClassifier(hinge)": lambda d: fit_online(d, "hinge", dealt=shards(d), **of),
        "Perceptron": lambda d: fit_online(d, "perceptron", dealt=shards(d), **of),
        "PassiveAggressiveClassifier": lambda d: fit_online(d, "pa", dealt=shards(d), **of),
        "LinearDiscriminantAnalysis": lambda d: M.fit_lda(d, **of),
        "LinearSVC": lambda d: fit_linear_svc(d, **of),
    }


def compare_models(train: DataFrame, test: DataFrame,
                   estimators: dict[str, Callable[[DataFrame], M.LinearScorer]] | None = None,
                   parallelism: int = 2, features: str = M.FEATURES, expand: Interactions | None = None) -> DataFrame:
    """One row per model with roc_auc, pr_auc (average precision),
    log_loss and brier_score (probability models only) and Matthews
    correlation; a failing model gives NULLs and its error text."""
    shards = Once(lambda d: Dealt(d, features))
    estimators = estimators or default_panel(expand, features, shards)
    spark = train.sparkSession
    if expand is None:
        train, test = train.persist(), test.persist()
    try:
        def run(item):
            name, fit = item
            try:
                return name, fit(train), None
            except Exception as e:  # noqa: BLE001 - the error is part of the result
                return name, None, f"{type(e).__name__}: {e}"[:2000] + "\n" + traceback.format_exc(limit=2)[-500:]

        with ThreadPoolExecutor(max_workers=parallelism) as ex:
            fitted = list(ex.map(run, estimators.items()))
        ok = {n: m for n, m, err in fitted if m is not None}
        errors = [(n, err) for n, m, err in fitted if m is None]
        parts = []
        if ok:
            scores = shared_table(M.score_many(test, ok, features, expand=expand), "panel-scores")     # four metric jobs read it
            parts.append(K.model_panel_metrics(scores).withColumn("error", F.lit(None).cast("string")))
        if errors:
            parts.append(spark.createDataFrame(
                [(n, None, None, None, None, None, e) for n, e in errors], PANEL_SCHEMA))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("model", "roc_auc", "pr_auc", "log_loss", "brier_score", "matthews_corrcoef", "error")
    finally:
        if shards.made:
            shards.made.close()
        if expand is None:
            train.unpersist()
            test.unpersist()


def top_models(panel: DataFrame, k: int = 5, by: str = "roc_auc") -> DataFrame:
    """The k best models by a metric (NULLs last)."""
    return panel.orderBy(F.desc_nulls_last(by), "model").limit(k)


# ------------------------------------------------------------ M15 / M16

def select_from_l1(train: DataFrame, Cs=(0.01, 0.1, 1.0, 10.0), cv: int = 5, scoring: str = "roc_auc",
                   threshold: float = 1e-5, balanced: bool = True, features: str = M.FEATURES,
                   expand: Interactions | None = None) -> tuple[list[int], M.LinearScorer]:
    """Indices of features with |coef| > threshold in an L1 logistic
    regression with C chosen by CV (class-balanced weights)."""
    w = M.class_weights(train) if balanced else None
    m = M.fit_logistic_cv(train, "l1", Cs=list(Cs), cv=cv, weights=w, scoring=scoring, features=features, expand=expand)
    keep = [i for i, v in enumerate(m.w) if abs(v) > threshold]
    return keep, m


def slice_features(df: DataFrame, keep: list[int], features: str = M.FEATURES) -> DataFrame:
    """VectorSlicer on the array column: keep the selected positions."""
    return df.withColumn(features, F.array(*[F.col(features)[i] for i in keep]) if keep
                         else F.array().cast("array<double>"))


@dataclass
class SelectThenClassify:
    """SelectFromModel(L1 LRCV, balanced) -> L2 LRCV (balanced)."""
    select_cv: int = 5
    final_cv: int = 5
    Cs: tuple = (0.01, 0.1, 1.0, 10.0)
    scoring: str = "roc_auc"

    def fit(self, train: DataFrame, features: str = M.FEATURES, expand: Interactions | None = None) -> M.LinearScorer:
        keep, first = select_from_l1(train, self.Cs, self.select_cv, self.scoring, features=features, expand=expand)
        m = M.fit_logistic_cv(train, "l2", Cs=list(self.Cs), cv=self.final_cv, weights=M.class_weights(train),
                              scoring=self.scoring, features=features, expand=expand,
                              keep=np.isin(np.arange(len(first.w)), keep))
        return M.LinearScorer("SelectFromModel+LogisticRegressionCV", m.w, m.b, link="logit",
                              info={"selected": keep, "best_C": m.info.get("best_C")})


# ------------------------------------------------------------ M17-M19

CS = (0.01, 0.1, 1.0, 10.0)


def _prepared(train: DataFrame, cv: int, inner: list[int], seed: int = 42, features: str = M.FEATURES,
              expand: Interactions | None = None) -> tuple[CellRows, dict, int]:
    """Rows with their outer and inner folds, fixed in a table of cells and read by every pass; class weights of every
    outer training part (None: all rows); number of features."""
    rows = cell_rows(train.where(F.col(M.LABEL).isNotNull()), features, [M.LABEL, M.KEY], expand)
    d = M.stratified_folds(rows.df, cv, seed=seed, out="outer")
    for k in inner:
        d = M.stratified_folds(d, k, seed=seed + k, out=f"f{k}")
    d = stored(rows.of(d.drop(M.KEY)))

    def tally(batches):
        acc = np.zeros((cv, 2))
        for _, _, b in blocks(batches, ["outer", M.LABEL]):
            outer, y = (b.column(i).to_numpy(zero_copy_only=False).astype(int) for i in (2, 3))
            for c in (0, 1):
                acc[:, c] += np.bincount(outer[y == c], minlength=cv)
        return {"": acc.ravel()}

    counts = tree_sums(d.table(["outer", M.LABEL]), tally).get("", np.zeros(2 * cv)).reshape(cv, 2)
    weights = {}
    for o in [*range(cv), None]:
        n = [int(v) for v in (counts.sum(axis=0) - (counts[o] if o is not None else 0))]
        weights[o] = tuple(sum(n) / (2.0 * x) if x else 0.0 for x in n)
    return d, weights, d.cells.width() - 1


def _aucs(d: CellRows, fits: list[Fit]) -> list[float]:
    """Exact AUC (K1) of every model on the rows that judge it, in one job."""
    got = K.roc_auc_of_runs(held_out_runs(d, fits))
    return [got.get(m, float("nan")) for m in range(len(fits))]


def _cross_validated(d: CellRows, p: int, weights: dict, jobs: list[tuple], l1: float, l2: float,
                     keeps: dict | None = None) -> dict[tuple, Fit]:
    """Logistic regression with C by inner cross-validation for every job (outer, inner cv, ...): all inner
    models of all jobs in lockstep along the path of C, then all refits in lockstep."""
    inner = [(job, k) for job in jobs for k in range(job[1])]
    keep = {job: keeps[job] if keeps else None for job in jobs}
    paths: dict[float, list[Fit]] = {}
    last: list = [None] * len(inner)
    for c in CS:
        paths[c] = fit_together(d, [Fit(job[0], f"f{job[1]}", k, c, l1, l2, weights[job[0]], keep=keep[job], beta=last[i])
                                    for i, (job, k) in enumerate(inner)], p)
        last = [f.beta for f in paths[c]]
    flat = [f for c in CS for f in paths[c]]
    auc = np.array(_aucs(d, flat)).reshape(len(CS), len(inner))
    best, start = {}, {}
    for job in jobs:
        at = [i for i, (j, _) in enumerate(inner) if j == job]
        means = auc[:, at].mean(axis=1)
        n = int(np.nanargmax(means)) if not np.isnan(means).all() else 0
        best[job], start[job] = CS[n], paths[CS[n]][at[0]].beta
    final = fit_together(d, [Fit(job[0], None, None, best[job], l1, l2, weights[job[0]], keep=keep[job], beta=start[job])
                             for job in jobs], p)
    return dict(zip(jobs, final, strict=True))


def _judged(d: CellRows, candidates: dict[str, dict], cv: int, link: str) -> tuple[DataFrame, M.LinearScorer]:
    """Mean and spread of the held-out AUC of ``{candidate: {outer fold or None: model}}``; the best one, fitted on all rows."""
    names = [(c, o) for c in candidates for o in range(cv)]
    auc = dict(zip(names, _aucs(d, [candidates[c][o] for c, o in names]), strict=True))
    rows = []
    for c, models in candidates.items():
        v = np.array([auc[c, o] for o in range(cv)])
        rows.append((c, float(v.mean()), float(v.std()), cv, all(f.converged for f in models.values())))
    best = max(rows, key=lambda r: (-np.inf if np.isnan(r[1]) else r[1], r[0]))[0]
    f = candidates[best][None]
    scorer = M.LinearScorer(best, f.beta[:-1], float(f.beta[-1]), link=link,
                            info={"best_candidate": best, "C": f.C, "converged": f.converged})
    table = d.df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], (
        "candidate string, mean_roc_auc double, std_roc_auc double, folds bigint, converged boolean, best boolean"))
    return table, scorer


def grid_l2(train: DataFrame, cv: int = 5, selects=(3, 5), finals=(3, 5), threshold: float = 1e-5, **of):
    """Select cv x final cv, C 0.01..10, roc_auc.  The selection depends on the select cv alone, so it is
    done once for both final cvs; every step moves all candidates and outer folds together.  ``of``: the array column
    (``features``) and what makes the features of it (``expand``), for this and the other searches."""
    d, weights, p = _prepared(train, cv, sorted({*selects, *finals}), **of)
    outers = [*range(cv), None]
    chosen = _cross_validated(d, p, weights, [(o, a) for o in outers for a in selects], 1.0, 0.0)
    keeps = {(o, b, a): np.abs(chosen[o, a].beta[:-1]) > threshold for o in outers for a in selects for b in finals}
    fitted = _cross_validated(d, p, weights, list(keeps), 0.0, 1.0, keeps)
    return _judged(d, {f"select_cv={a},final_cv={b}": {o: fitted[o, b, a] for o in outers}
                       for a in selects for b in finals}, cv, "logit")


def grid_l1(train: DataFrame, cv: int = 5, inner=(3, 5, 10), **of):
    """L1 logistic regression with balanced classes, C 0.01..10 by inner cv of 3, 5 or 10, roc_auc."""
    d, weights, p = _prepared(train, cv, list(inner), **of)
    outers = [*range(cv), None]
    fitted = _cross_validated(d, p, weights, [(o, k) for o in outers for k in inner], 1.0, 0.0)
    return _judged(d, {f"cv={k}": {o: fitted[o, k] for o in outers} for k in inner}, cv, "logit")


def grid_svc(train: DataFrame, cv: int = 5, Cs=CS, **of):
    """L1 linear SVM (squared hinge, balanced), C in 0.01, 0.1, 1, 10."""
    d, weights, p = _prepared(train, cv, [], **of)
    outers = [*range(cv), None]
    last = {o: None for o in outers}
    out: dict[str, dict] = {}
    for c in sorted(Cs):
        fits = fit_together(d, [Fit(o, None, None, c, 1.0, 0.0, weights[o], "squared_hinge", True, beta=last[o])
                                for o in outers], p)
        out[f"C={c}"] = dict(zip(outers, fits, strict=True))
        last = {o: f.beta for o, f in out[f"C={c}"].items()}
    return _judged(d, out, cv, "none")
