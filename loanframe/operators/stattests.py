"""Tests on missingness and distribution.

Every test has the same shape: Spark reduces the whole table to sufficient
statistics in one pass (a global or grouped aggregate with map-side partial
aggregation), and a tiny function turns those statistics into p-values.
No test collects rows; the only driver-side values are per-test constants.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanframe.functions.dist import chi2_pvalue, t_pvalue
from loanframe.session import shared_table


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


# --------------------------------------------------------------------- T2/T3

def welch_stats(df: DataFrame, features: list[str], flags: list[str]) -> DataFrame:
    """T2 sufficient statistics and Welch t for every (feature, flag) pair.

    One aggregate for all pairs: per pair the count, mean and sample variance
    of the feature where the flag is false (observed) and true (missing).
    The result is one row per pair; t and the Welch-Satterthwaite degrees of
    freedom are column algebra on it.  NULL features are left out.
    """
    aggs, structs = [], []
    for i, feat in enumerate(features):
        for j, flag in enumerate(flags):
            x, g = F.col(feat).cast("double"), F.col(flag).cast("boolean")
            obs, mis = F.when(~g, x), F.when(g, x)
            k = f"_{i}_{j}"
            aggs += [F.count(obs).alias(f"n0{k}"), F.avg(obs).alias(f"m0{k}"),
                     F.var_samp(obs).alias(f"v0{k}"), F.count(mis).alias(f"n1{k}"),
                     F.avg(mis).alias(f"m1{k}"), F.var_samp(mis).alias(f"v1{k}")]
            structs.append(F.struct(
                F.lit(feat).alias("feature"), F.lit(flag).alias("flag"),
                F.col(f"n0{k}").alias("n_obs"), F.col(f"n1{k}").alias("n_mis"),
                F.col(f"m0{k}").alias("mean_obs"), F.col(f"m1{k}").alias("mean_mis"),
                F.col(f"v0{k}").alias("var_obs"), F.col(f"v1{k}").alias("var_mis")))
    long = df.agg(*aggs).select(F.inline(F.array(*structs)))
    se0 = F.col("var_obs") / F.col("n_obs")
    se1 = F.col("var_mis") / F.col("n_mis")
    se = se0 + se1
    t = _safe_div(F.col("mean_obs") - F.col("mean_mis"), F.sqrt(se))
    dof = _safe_div(se * se, se0 * se0 / (F.col("n_obs") - 1) + se1 * se1 / (F.col("n_mis") - 1))
    return long.withColumns({"t_stat": t, "dof": dof})


def welch_t_tests(df: DataFrame, features: list[str], flags: list[str],
                  alpha: float = 0.05) -> DataFrame:
    """T2 with two-sided p-values and the verdict (reject when p <= alpha)."""
    s = welch_stats(df, features, flags)
    p = t_pvalue(F.col("t_stat"), F.col("dof"))
    return s.withColumn("p_value", p).withColumn("reject_h0", F.col("p_value") <= alpha)


def rejection_counts(tests: DataFrame, alpha: float = 0.05, inclusive: bool = True) -> DataFrame:
    """Per flag, how many features reject / keep H0 (MCAR)."""
    rej = F.col("p_value") <= alpha if inclusive else F.col("p_value") < alpha
    return tests.groupBy("flag").agg(
        F.count_if(rej).alias("n_reject"), F.count_if(~rej).alias("n_keep"))


# --------------------------------------------------------------------- T6/T7

def contingency_long(df: DataFrame, rows: list[str], cols: list[str]) -> DataFrame:
    """Long contingency counts of every (row column, column column) pair in
    one grouped pass: unpivot the row columns, group by (pair, levels)."""
    stacked = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(r).alias("row_var"), F.col(r).cast("string").alias("row_level"),
                     F.lit(c).alias("col_var"), F.col(c).cast("string").alias("col_level"))
            for r in rows for c in cols])).alias("s")).select("s.*")
    stacked = stacked.filter(F.col("row_level").isNotNull() & F.col("col_level").isNotNull())
    return stacked.groupBy("row_var", "col_var", "row_level", "col_level").agg(
        F.count(F.lit(1)).alias("observed"))


def crosstab(df: DataFrame, row: str, col: str, levels: list | None = None) -> DataFrame:
    """A wide contingency table; ``levels`` avoids the extra pass of pivot."""
    g = df.groupBy(F.col(row).cast("string").alias(row))
    piv = g.pivot(col, levels) if levels is not None else g.pivot(col)
    return piv.count().na.fill(0)


def chi2_independence(df: DataFrame, rows: list[str], cols: list[str],
                      correction: bool = True) -> DataFrame:
    """Chi-square test of independence for every (row, col) pair.

    Expected counts come from row and column totals (window sums over the
    small long contingency table, partitioned by pair).  Yates' correction is
    applied when dof = 1.  NULL levels are left out.
    """
    ct = contingency_long(df, rows, cols)
    return chi2_from_counts(ct, correction)


def chi2_from_counts(ct: DataFrame, correction: bool = True) -> DataFrame:
    from pyspark.sql import Window as W
    pair = ["row_var", "col_var"]
    wp = W.partitionBy(*pair)
    e = (ct.withColumn("row_total", F.sum("observed").over(W.partitionBy(*pair, "row_level")))
         .withColumn("col_total", F.sum("observed").over(W.partitionBy(*pair, "col_level")))
         .withColumn("total", F.sum("observed").over(wp))
         .withColumn("n_rows", F.size(F.collect_set("row_level").over(wp)))
         .withColumn("n_cols", F.size(F.collect_set("col_level").over(wp))))
    e = e.withColumn("expected", F.col("row_total").cast("double") * F.col("col_total") / F.col("total"))
    e = e.withColumn("dof", ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).cast("bigint"))
    diff = F.abs(F.col("observed") - F.col("expected"))
    if correction:
        diff = F.when(F.col("dof") == 1, F.greatest(diff - 0.5, F.lit(0.0))).otherwise(diff)
    e = e.withColumn("term", diff * diff / F.col("expected"))
    stat = e.groupBy(*pair).agg(F.sum("term").alias("statistic"), F.first("dof").alias("dof"))
    return stat.withColumn("p_value", chi2_pvalue(F.col("statistic"), F.col("dof").cast("double")))


# --------------------------------------------------------------------- T1

def pattern_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per missing-value pattern (bitmask, bit i = column i is NULL): row
    count and the mean of every column within the pattern."""
    mask = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(cols)), F.lit(0))
    return df.groupBy(mask.alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in cols])


def little_mcar(df: DataFrame, cols: list[str]) -> dict:
    """Little's chi-square test that data are missing completely at random, for any number of columns.

    Means and covariances are pairwise complete (NULLs skipped per pair): one
    pass adds the cross products of the columns about a first guess of
    their means, with the number of rows that have both.  Rows are then grouped by the
    text of their pattern; m_j (ybar_j - mu)' S_jj^-1 (ybar_j - mu) is
    computed where a pattern's means are, and summed by an aggregate, so that no list of patterns is collected.
    """
    import numpy as np

    from loanframe.functions.dist import chi2_sf
    from loanframe.functions.gram import ArrowBatch, partition_sums
    p = len(cols)
    x = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    first = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    mu = np.array([np.nan if v is None else v for v in first], dtype=float)

    def products(b: ArrowBatch) -> np.ndarray:
        z = b.matrix("x") - mu
        has = (~np.isnan(z)).astype(float)
        z = np.where(has > 0, z, 0.0)
        return np.concatenate([v.ravel() for v in (has.T @ has, z.T @ z, z.T @ has)])

    n, zz, zh = partition_sums(x, products, 3 * p * p).reshape(3, p, p)      # zh[i, j]: sum of column i where j is there
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = (zz - zh * zh.T / n) / (n - 1)

    def term(batches):
        for b in batches:
            d2, seen = [], []
            means = ArrowBatch(b).matrix("means")
            for pattern, size, mean in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), means):
                obs = [i for i in range(p) if pattern[i] == "1"]
                seen.append(len(obs))
                diff = mean[obs] - mu[obs]
                d2.append(size * float(diff @ np.linalg.solve(cov[np.ix_(obs, obs)], diff)) if obs else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(d2, pa.float64()), pa.array(seen, pa.int64())], names=["d2", "seen"])

    pattern = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols])
    means = df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)])
    means = means.select("pattern", "n", F.array(*[f"a{i}" for i in range(p)]).alias("means"))
    r = means.mapInArrow(term, "d2 double, seen long").agg(F.sum("d2").alias("d2"), F.sum("seen").alias("seen")).first()
    d2, dof = r["d2"] or 0.0, (r["seen"] or 0) - p
    return {"statistic": d2, "dof": dof, "p_value": chi2_sf(d2, dof) if dof > 0 else float("nan")}


# --------------------------------------------------------------------- T4/T5

def logit_summary(df: DataFrame, label: str, predictors: list[str], max_iter: int = 25) -> DataFrame:
    """T4 / T5: logistic regression of a 0/1 flag with its summary table.

    Spark's GLM (binomial, logit) by IRLS: each iteration one distributed
    weighted Gram; rows with a NULL predictor are skipped.  Output: one row
    per term (intercept last) with coefficient, standard error, z, p, plus
    deviance, null deviance, AIC and McFadden's pseudo R-squared.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    va = VectorAssembler(inputCols=predictors, outputCol="_x", handleInvalid="skip")
    rows = df.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in predictors])
    data = va.transform(shared_table(rows, "logit-rows")).select("_x", "_y").persist()      # a step is a pass over these, not the sources
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_y",
                                      maxIter=max_iter, regParam=0.0)
    try:
        m = glm.fit(data)
        s = m.summary
        terms = predictors + ["Intercept"]
        coefs = list(m.coefficients) + [m.intercept]
        se, tv, pv = s.coefficientStandardErrors, s.tValues, s.pValues
        deviance, null_deviance, aic = float(s.deviance), float(s.nullDeviance), float(s.aic)
    finally:
        data.unpersist()
    r2 = 1.0 - deviance / null_deviance if null_deviance else None
    rows = [(label, t, float(c), float(a), float(b), float(d), deviance, null_deviance, aic, r2)
            for t, c, a, b, d in zip(terms, coefs, se, tv, pv)]
    return df.sparkSession.createDataFrame(
        rows, "flag string, term string, coef double, std_err double, z double, p_value double,"
              " deviance double, null_deviance double, aic double, pseudo_r2 double")


# --------------------------------------------------------------------- T8

def _poly(c, x):
    out = 0.0
    for k, v in enumerate(c):
        out += v * x ** k
    return out


# Royston (1995) polynomial coefficients of the Shapiro-Wilk
# approximation (algorithm AS R94).
SW_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_C6 = [-0.4803, -0.082676, 0.0030302]
SW_G = [-2.273, 0.459]


class ScoreSums:
    """Prefix sums S(k) = m_1 + ... + m_k of the normal scores m_i = ppf((i - 3/8) / (n + 1/4)), for any n.

    The first ``TAIL`` are added up; beyond them the scores are so smooth in i that
    the integral and one Euler-Maclaurin term are exact to rounding.  S(k) = S(n - k), as
    scores come in pairs of opposite sign.
    """
    TAIL = 8192

    def __init__(self, n: int):
        import numpy as np

        from loanframe.functions.dist import norm_ppf
        self.n, self.ppf = n, norm_ppf
        self.t = min(n // 2, self.TAIL)
        head = self.score(np.arange(1, self.t + 1))
        self.head = np.concatenate([[0.0], np.cumsum(head)])
        half = float(np.sum(head * head))
        if n // 2 > self.t:
            lo, hi = (self._squares(np.array([k + 0.5]))[0] for k in (self.t, n // 2))
            half += float(hi - lo)
        self.squares = 2.0 * half                              # the middle score of an odd n is 0

    def score(self, i):
        return self.ppf((i - 0.375) / (self.n + 0.25))

    def _density(self, z):
        import numpy as np
        return np.exp(-z * z / 2.0) / np.sqrt(2.0 * np.pi)

    def _plain(self, i):
        """Integral of the scores up to i less the correction: differences of these are sums."""
        z, scale = self.score(i), self.n + 0.25
        d = self._density(z)
        return -scale * d - 1.0 / (24.0 * scale * d)

    def _squares(self, i):
        z, scale = self.score(i), self.n + 0.25
        d = self._density(z)
        return scale * ((i - 0.375) / scale - z * d) - 2.0 * z / (24.0 * scale * d)

    def upto(self, k):
        """S(k) of an array of ranks, 0 to n."""
        import numpy as np
        k = np.minimum(k, self.n - k)
        out = self.head[np.minimum(k, self.t)]
        far = k > self.t
        if far.any():
            out[far] += self._plain(k[far] + 0.5) - self._plain(np.array([self.t + 0.5]))
        return out


def shapiro_wilk(df: DataFrame, col: str, p_limit: int = 5000) -> dict:
    """T8 of one column (see ``shapiro_wilk_all``)."""
    return shapiro_wilk_all(df, [col], p_limit)[0]


def shapiro_wilk_all(df: DataFrame, cols: list[str], p_limit: int = 5000) -> list[dict]:
    """Shapiro-Wilk W and p (Royston 1995) of each column, NULLs left out; all columns in the same jobs.

    Distinct values get their rank ranges from distributed running sums (X1).
    What a value with the ranks (a, b] adds to W is its distance from the mean times
    the sum of the normal scores of these ranks, two look-ups in their prefix sums:
    no rank is written out, whatever the number of equal values.
    """
    import numpy as np

    from loanframe.functions.ordering import running_sums
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("x"))
                                        for i, c in enumerate(cols)]))).where("x IS NOT NULL")
    counts = shared_table(rows.groupBy("c", "x").agg(F.count("*").alias("n")), "shapiro-value")
    total = {r["c"]: (r["n"], r["mean"]) for r in counts.groupBy("c").agg(
        F.sum("n").alias("n"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    sums = {c: ScoreSums(n) for c, (n, _) in total.items()}
    ranked = running_sums(counts, "c", "x", ["n"]).select("c", "x", "n", "cum_n")

    def parts(batches):
        for b in batches:
            c, x, n, upto = (b.column(i).to_numpy() for i in range(4))
            mean, score, ends = np.zeros(len(c)), np.zeros(len(c)), np.zeros((len(c), 4), dtype=bool)
            for k, (size, m) in total.items():
                at = c == k
                mean[at] = m
                score[at] = sums[k].upto(upto[at]) - sums[k].upto(upto[at] - n[at])
                for j, rank in enumerate((1, 2, size - 1, size)):
                    ends[at, j] = (upto[at] - n[at] < rank) & (rank <= upto[at])
            gap = x - mean
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(gap * score), pa.array(n * gap * gap),
                 *(pa.array(gap, mask=~ends[:, j]) for j in range(4))], names=["c", "num", "ss", "e0", "e1", "e2", "e3"])

    found = ranked.mapInArrow(parts, "c int, num double, ss double, e0 double, e1 double, e2 double, e3 double")
    found = {r["c"]: r for r in found.groupBy("c").agg(
        F.sum("num").alias("num"), F.sum("ss").alias("ss"), *[F.max(f"e{j}").alias(f"e{j}") for j in range(4)]).collect()}
    out = []
    for i, name in enumerate(cols):
        n = total.get(i, (0, 0.0))[0]
        r = found.get(i)
        out.append(_royston(name, n, sums.get(i), r["num"], r["ss"], [r[f"e{j}"] for j in range(4)], p_limit) if n >= 3 else
                   {"column": name, "n": n, "W": None, "p_value": None, "p_valid": False})
    return out


def _royston(col: str, n: int, sums: ScoreSums, num: float, ss: float, ends: list[float], p_limit: int) -> dict:
    """W and p from the sums of scores times distances from the mean; ``ends``: distances of the ranks 1, 2, n - 1, n."""
    import math

    import numpy as np

    from loanframe.functions.dist import norm_sf
    if not ss:
        return {"column": col, "n": n, "W": None, "p_value": None, "p_valid": False}
    mn, mn1 = (float(v) for v in sums.score(np.array([n, n - 1], dtype=float)))
    m2, u = sums.squares, 1.0 / math.sqrt(n)
    an = _poly(SW_C1, u) + mn / math.sqrt(m2)
    if n == 3:
        top = math.sqrt(0.5) * (ends[3] - ends[0])
    elif n > 5:
        an1 = _poly(SW_C2, u) + mn1 / math.sqrt(m2)
        root = math.sqrt((m2 - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1))
        top = num / root + (an - mn / root) * (ends[3] - ends[0]) + (an1 - mn1 / root) * (ends[2] - ends[1])
    else:
        root = math.sqrt((m2 - 2 * mn * mn) / (1 - 2 * an * an))
        top = num / root + (an - mn / root) * (ends[3] - ends[0])
    W = top * top / ss
    W = min(W, 1.0)
    if n == 3:
        pw = max(0.0, 6 / math.pi * (math.asin(math.sqrt(W)) - math.asin(math.sqrt(0.75))))
    elif n <= 11:
        gamma = _poly(SW_G, n)
        m = _poly(SW_C3, n)
        s = math.exp(_poly(SW_C4, n))
        y = -math.log(gamma - math.log1p(-W)) if gamma - math.log1p(-W) > 0 else float("inf")
        pw = float(norm_sf(np.array([(y - m) / s]))[0])
    else:
        ln_n = math.log(n)
        m = _poly(SW_C5, ln_n)
        s = math.exp(_poly(SW_C6, ln_n))
        pw = float(norm_sf(np.array([(math.log1p(-W) - m) / s]))[0]) if W < 1 else 1.0
    return {"column": col, "n": n, "W": W, "p_value": pw, "p_valid": n <= p_limit}
