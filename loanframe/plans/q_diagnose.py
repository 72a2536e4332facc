"""Registered queries: duplicates, null profile, missingness tests, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanframe.operators import stattests as T
from loanframe.plans.catalog import register
from loanframe.sources import loans as L

T2_FEATURES = ["person_age", "person_income", "loan_amnt"]
T2_FLAGS = list(L.FLAG_SOURCES)


def _flags_sql() -> str:
    return ", ".join(f"{c} IS NULL AS {f}" for f, c in L.FLAG_SOURCES.items())


def _welch_sql(src: str, features: list[str], flags: list[str]) -> str:
    parts = []
    for feat in features:
        for flag in flags:
            x = f"CAST({feat} AS DOUBLE)"
            o, m = f"CASE WHEN NOT {flag} THEN {x} END", f"CASE WHEN {flag} THEN {x} END"
            parts.append(
                f"SELECT '{feat}' AS feature, '{flag}' AS flag, count({o}) AS n_obs, count({m}) AS n_mis,"
                f" avg({o}) AS mean_obs, avg({m}) AS mean_mis, var_samp({o}) AS var_obs,"
                f" var_samp({m}) AS var_mis FROM {src}")
    union = "\nUNION ALL ".join(parts)
    return f""", welch AS ({union})
SELECT *,
  CASE WHEN var_obs / n_obs + var_mis / n_mis <> 0
       THEN (mean_obs - mean_mis) / sqrt(var_obs / n_obs + var_mis / n_mis) END AS t_stat,
  CASE WHEN (var_obs / n_obs) * (var_obs / n_obs) / (n_obs - 1)
            + (var_mis / n_mis) * (var_mis / n_mis) / (n_mis - 1) <> 0
       THEN (var_obs / n_obs + var_mis / n_mis) * (var_obs / n_obs + var_mis / n_mis)
            / ((var_obs / n_obs) * (var_obs / n_obs) / (n_obs - 1)
               + (var_mis / n_mis) * (var_mis / n_mis) / (n_mis - 1)) END AS dof
FROM welch"""


_WELCH_ROUND = {"mean_obs": 6, "mean_mis": 6, "var_obs": 2, "var_mis": 2, "t_stat": 6, "dof": 4}


def flagged_dedup(spark, sf_dir):
    return L.with_flags(L.deduped(spark, sf_dir))


@register("t2_welch",
          sql=L.with_loans(f", flagged AS (SELECT *, {_flags_sql()} FROM dedup)"
                           + _welch_sql("flagged", T2_FEATURES, T2_FLAGS)),
          rounding=_WELCH_ROUND)
def t2_welch(spark, sf_dir):
    """Flagship: does missingness of employment length / interest rate
    depend on the numeric columns?  Welch t for every (feature, flag)."""
    return T.welch_stats(flagged_dedup(spark, sf_dir), T2_FEATURES, T2_FLAGS)


@register("t2_welch_pvalues")
def t2_welch_pvalues(spark, sf_dir):
    return T.welch_t_tests(flagged_dedup(spark, sf_dir), T2_FEATURES, T2_FLAGS).select(
        "feature", "flag", "t_stat", "dof", "p_value", "reject_h0")


# critical t at 5 % by its expansion in 1 / dof (dof in the thousands here): p <= 0.05 beyond it
_Z = 1.959963984540054
_T_CRITICAL = (f"({_Z} + {(_Z ** 3 + _Z) / 4} / dof + {(5 * _Z ** 5 + 16 * _Z ** 3 + 3 * _Z) / 96} / (dof * dof)"
               f" + {(3 * _Z ** 7 + 19 * _Z ** 5 + 17 * _Z ** 3 - 15 * _Z) / 384} / (dof * dof * dof))")


@register("t3_rejection_counts", sql="SELECT flag, count_if(abs(t_stat) >= " + _T_CRITICAL + ") AS n_reject, count_if(abs(t_stat) < "
          + _T_CRITICAL + ") AS n_keep FROM (" + L.with_loans(
              f", flagged AS (SELECT *, {_flags_sql()} FROM dedup)" + _welch_sql("flagged", T2_FEATURES, T2_FLAGS)) + ") AS w GROUP BY flag")
def t3_rejection_counts(spark, sf_dir):
    tests = T.welch_t_tests(flagged_dedup(spark, sf_dir), T2_FEATURES, T2_FLAGS)
    return T.rejection_counts(tests)


# ----------------------------------------------------------- duplicates D1-D4

from loanframe.functions import columns as P  # noqa: E402
from loanframe.operators import outliers as O  # noqa: E402
from loanframe.operators import profile as D  # noqa: E402

LOAN_COLUMNS = ["loan_id", "person_age", "person_income", "person_home_ownership",
                "person_emp_length", "loan_intent", "loan_grade", "loan_amnt",
                "loan_int_rate", "cb_person_default_on_file", "loan_status"]
LOAN_TYPES = ["bigint", "bigint", "double", "string", "double", "string", "string", "double",
              "double", "boolean", "boolean"]
_ALL = ", ".join(LOAN_COLUMNS)


@register("d1_flag_duplicates",
          sql=L.with_loans(f"SELECT *, row_number() OVER (PARTITION BY {_ALL}) > 1 AS is_duplicate FROM loans"))
def d1_flag_duplicates(spark, sf_dir):
    return D.flag_duplicates(L.loans(spark, sf_dir))


@register("d2_duplicate_rows",
          sql=L.with_loans(f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {_ALL})"
                           " AS rn FROM loans) WHERE rn > 1"))
def d2_duplicate_rows(spark, sf_dir):
    return D.duplicate_rows(L.loans(spark, sf_dir))


@register("d3_dedupe", sql=L.with_loans("SELECT * FROM dedup"))
def d3_dedupe(spark, sf_dir):
    return D.drop_duplicates(L.loans(spark, sf_dir))


@register("d4_shape",
          sql=L.with_loans("SELECT (SELECT count(*) FROM loans) AS rows_before,"
                           " (SELECT count(*) FROM dedup) AS rows_after,"
                           f" CAST({len(LOAN_COLUMNS)} AS BIGINT) AS n_columns"))
def d4_shape(spark, sf_dir):
    return D.shape_before_after(L.loans(spark, sf_dir))


# ------------------------------------------------------------ profile N1-N9

def _profile_sql(src: str) -> str:
    parts = [f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", '{t}' AS dtype,"
             f" count({c}) AS non_null, count(*) AS n_rows FROM {src}"
             for i, (c, t) in enumerate(zip(LOAN_COLUMNS, LOAN_TYPES))]
    return ", prof AS (" + " UNION ALL ".join(parts) + ")\n"


@register("n1_info", sql=L.with_loans(_profile_sql("dedup")
                                      + "SELECT position, \"column\", dtype, non_null FROM prof"))
def n1_info(spark, sf_dir):
    return D.column_profile(L.deduped(spark, sf_dir)).select("position", "column", "dtype", "non_null")


@register("n2_null_counts", sql=L.with_loans(
    _profile_sql("dedup") + "SELECT \"column\", n_rows - non_null AS null_count FROM prof"))
def n2_null_counts(spark, sf_dir):
    return D.column_profile(L.deduped(spark, sf_dir)).select("column", "null_count")


@register("n3_null_share", sql=L.with_loans(
    _profile_sql("dedup") + "SELECT \"column\", (n_rows - non_null) / n_rows AS null_share FROM prof"),
    rounding={"null_share": 9})
def n3_null_share(spark, sf_dir):
    return D.column_profile(L.deduped(spark, sf_dir)).select("column", "null_share")


_ALL_NULL = " AND ".join(f"{c} IS NULL" for c in LOAN_COLUMNS)
_EMPTY_COLS = " + ".join(f"CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END" for c in LOAN_COLUMNS)


@register("n4_empty_rows", sql=L.with_loans(f"SELECT count_if({_ALL_NULL}) AS empty_rows FROM dedup"))
def n4_empty_rows(spark, sf_dir):
    return D.empty_counts(L.deduped(spark, sf_dir)).select("empty_rows")


@register("n5_empty_columns",
          sql=L.with_loans(f"SELECT CAST({_EMPTY_COLS} AS BIGINT) AS empty_columns FROM dedup"))
def n5_empty_columns(spark, sf_dir):
    return D.empty_counts(L.deduped(spark, sf_dir)).select("empty_columns")


@register("n6_null_counts_wide", sql=L.with_loans(
    "SELECT " + ", ".join(f"count_if({c} IS NULL) AS {c}" for c in LOAN_COLUMNS) + " FROM dedup"))
def n6_null_counts_wide(spark, sf_dir):
    return D.null_counts_wide(L.deduped(spark, sf_dir))


_FLAG_COLS = [c for c in LOAN_COLUMNS if c != "loan_id"]


@register("n7_null_flags_long", sql=L.with_loans(" UNION ALL ".join(
    f"SELECT loan_id, '{c}' AS variable, {c} IS NULL AS missing FROM dedup" for c in _FLAG_COLS)))
def n7_null_flags_long(spark, sf_dir):
    return D.null_flags_long(L.deduped(spark, sf_dir), _FLAG_COLS, key="loan_id")


_PAT = ["person_emp_length", "loan_int_rate"]


@register("n8_missing_patterns", sql=L.with_loans(
    "SELECT " + ", ".join(f"CAST(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS INT) AS {c}" for c in _PAT)
    + ", CAST(" + " + ".join(f"CAST({c} IS NULL AS INT)" for c in _PAT) + " AS INT) AS n_missing,"
    " count(*) AS row_count FROM dedup GROUP BY ALL"))
def n8_missing_patterns(spark, sf_dir):
    return D.missing_patterns(L.deduped(spark, sf_dir), _PAT)


_FLAGS_AS_INT = ", ".join(f"CAST(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS INT) AS {c}" for c in _PAT)


@register("n8_pattern_margins", sql=L.with_loans(
    f", f AS (SELECT {_FLAGS_AS_INT} FROM dedup)"
    " SELECT NULL AS variable, " + ", ".join(_PAT) + ", CAST(" + " + ".join(f"1 - {c}" for c in _PAT) + " AS INT) AS n_missing,"
    " count(*) AS row_count FROM f GROUP BY ALL"
    + "".join(f" UNION ALL SELECT '{c}', " + ", ".join("0" if x == c else "NULL" for x in _PAT)
              + f", NULL, count_if({c} = 0) FROM f" for c in _PAT)))
def n8_pattern_margins(spark, sf_dir):
    return D.patterns_with_margins(L.deduped(spark, sf_dir), _PAT)


@register("n9_value_counts", sql=L.with_loans(
    "SELECT person_age, count(*) AS count FROM dedup WHERE person_age IS NOT NULL GROUP BY person_age"))
def n9_value_counts(spark, sf_dir):
    return D.value_counts(L.deduped(spark, sf_dir), "person_age")


@register("c2_null_bars", sql=L.with_loans(
    _profile_sql("dedup") + "SELECT \"column\", n_rows - non_null AS null_count FROM prof"))
def c2_null_bars(spark, sf_dir):
    return D.column_profile(L.deduped(spark, sf_dir)).select("column", "null_count")


@register("c5_null_heatmap", sql=L.with_loans(
    ", b AS (SELECT min(loan_id) AS lo, max(loan_id) AS hi FROM dedup),"
    " g AS (SELECT CAST(floor(CAST(loan_id - lo AS DOUBLE) * 50.0 / CAST(hi - lo + 1 AS DOUBLE)) AS BIGINT)"
    " AS block, * FROM dedup, b)\n"
    + " UNION ALL ".join(f"SELECT block, '{c}' AS variable, count_if({c} IS NULL) / count(*) AS null_share"
                         f" FROM g GROUP BY block" for c in _FLAG_COLS)),
    rounding={"null_share": 9})
def c5_null_heatmap(spark, sf_dir):
    return D.null_heatmap(L.deduped(spark, sf_dir), "loan_id", _FLAG_COLS, 50)


@register("c6_null_share_bars", sql=L.with_loans(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, {m} AS missing, count_if(({c} IS NULL) = {m}) AS count,"
    f" count_if(({c} IS NULL) = {m}) / count(*) AS share FROM dedup"
    for c in _FLAG_COLS for m in ("false", "true"))), rounding={"share": 9})
def c6_null_share_bars(spark, sf_dir):
    return D.null_share_bars(L.deduped(spark, sf_dir), _FLAG_COLS)


# ------------------------------------------------------------ columns P1-P14

@register("p1_select", sql=L.with_loans("SELECT loan_id, person_income, loan_status FROM dedup"))
def p1_select(spark, sf_dir):
    return P.select_columns(L.deduped(spark, sf_dir), ["loan_id", "person_income", "loan_status"])


@register("p2_drop", sql=L.with_loans("SELECT * EXCLUDE (person_emp_length, loan_int_rate) FROM dedup"))
def p2_drop(spark, sf_dir):
    return P.drop_columns(L.deduped(spark, sf_dir), ["person_emp_length", "loan_int_rate"])


@register("p3_numeric_columns", sql=L.with_loans(
    "SELECT loan_id, person_age, person_income, person_emp_length, loan_amnt, loan_int_rate FROM dedup"))
def p3_numeric_columns(spark, sf_dir):
    d = L.deduped(spark, sf_dir)
    return d.select("loan_id", *P.columns_of_kind(d, "numeric", exclude=["loan_id"]))


@register("p4_null_flags", sql=L.with_loans(
    "SELECT loan_id, person_emp_length IS NULL AS pel_missing, loan_int_rate IS NULL AS lir_missing FROM dedup"))
def p4_null_flags(spark, sf_dir):
    return P.null_flags(L.deduped(spark, sf_dir), ["person_emp_length", "loan_int_rate"],
                        names={"person_emp_length": "pel_missing", "loan_int_rate": "lir_missing"}
                        ).select("loan_id", "pel_missing", "lir_missing")


@register("p5_casts", sql=L.with_loans(
    "SELECT loan_id, CAST(person_emp_length IS NULL AS INT) AS pel_missing,"
    " CAST(cb_person_default_on_file AS VARCHAR) AS cb_person_default_on_file FROM dedup"))
def p5_casts(spark, sf_dir):
    d = P.null_flags(L.deduped(spark, sf_dir), ["person_emp_length"], names={"person_emp_length": "pel_missing"})
    return P.cast_columns(d, {"pel_missing": "int", "cb_person_default_on_file": "string"}).select(
        "loan_id", "pel_missing", "cb_person_default_on_file")


@register("p6_merge_levels", sql=L.with_loans(
    "SELECT loan_id, CASE WHEN person_home_ownership = 'OTHER' THEN 'MORTGAGE' ELSE person_home_ownership END"
    " AS person_home_ownership, CASE WHEN loan_grade = 'G' THEN 'F' ELSE loan_grade END AS loan_grade FROM dedup"))
def p6_merge_levels(spark, sf_dir):
    d = P.replace_levels(L.deduped(spark, sf_dir), "person_home_ownership", {"OTHER": "MORTGAGE"})
    d = P.replace_levels(d, "loan_grade", {"G": "F"})
    return d.select("loan_id", "person_home_ownership", "loan_grade")


@register("p7_range_filter", sql=L.with_loans(
    ", q AS (SELECT quantile_cont(person_income, 0.25) AS q1, quantile_cont(person_income, 0.75) AS q3 FROM train)"
    " SELECT loan_id, person_income FROM train, q"
    " WHERE person_income < q1 - (q3 - q1) * 1.5 OR person_income > q3 + (q3 - q1) * 1.5"))
def p7_range_filter(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    lo, hi = O.iqr_fences(train, ["person_income"])["person_income"]
    return train.filter(P.outside("person_income", lo, hi)).select("loan_id", "person_income")


@register("p8_concat", sql=L.with_loans(
    "SELECT loan_id, person_home_ownership || '_' || loan_grade AS new FROM dedup"))
def p8_concat(spark, sf_dir):
    return L.deduped(spark, sf_dir).select(
        "loan_id", P.concat_levels("person_home_ownership", "loan_grade").alias("new"))


@register("p9_fill_none", sql=L.with_loans(
    "SELECT loan_id, coalesce(CAST(loan_int_rate AS VARCHAR), 'NONE') AS loan_int_rate FROM dedup"))
def p9_fill_none(spark, sf_dir):
    return L.deduped(spark, sf_dir).select("loan_id", P.fill_text("loan_int_rate").alias("loan_int_rate"))


@register("p10_log1p", sql=L.with_loans(
    "SELECT loan_id, CASE WHEN person_income > -1 THEN ln(1 + person_income) END AS person_income,"
    " CASE WHEN loan_amnt > -1 THEN ln(1 + loan_amnt) END AS loan_amnt FROM dedup"),
    rounding={"person_income": 9, "loan_amnt": 9})
def p10_log1p(spark, sf_dir):
    return L.deduped(spark, sf_dir).select(
        "loan_id", P.log1p("person_income").alias("person_income"), P.log1p("loan_amnt").alias("loan_amnt"))


@register("p11_append_columns", sql=L.with_loans(
    "SELECT *, person_emp_length IS NULL AS pel_missing, loan_int_rate IS NULL AS lir_missing FROM dedup"))
def p11_append_columns(spark, sf_dir):
    return L.with_flags(L.deduped(spark, sf_dir))


@register("p12_head", sql=L.with_loans("SELECT * FROM dedup ORDER BY loan_id LIMIT 5"))
def p12_head(spark, sf_dir):
    return P.head(L.deduped(spark, sf_dir), 5, ["loan_id"])


@register("p13_sort", sql=L.with_loans("SELECT loan_id, person_income FROM dedup"))
def p13_sort(spark, sf_dir):
    return L.deduped(spark, sf_dir).select("loan_id", "person_income").orderBy(
        F.desc("person_income"), "loan_id")


@register("p14_top_k", sql=L.with_loans(
    "SELECT loan_id, loan_amnt FROM dedup ORDER BY loan_amnt DESC NULLS LAST, loan_id LIMIT 5"))
def p14_top_k(spark, sf_dir):
    return P.top_k(L.deduped(spark, sf_dir).select("loan_id", "loan_amnt"), "loan_amnt", 5, ["loan_id"])


# ----------------------------------------------------------- outliers O1-O5

def _quartile_sql(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}"
        for c in cols)


_Q_ROUND = {"q1": 6, "q3": 6, "iqr": 6, "lower": 6, "upper": 6}


@register("o1_quartiles", sql=L.with_loans(f", qt AS ({_quartile_sql('train', L.NUMERIC)})"
                                           " SELECT \"column\", q1, q3 FROM qt"),
          rounding={"q1": 6, "q3": 6})
def o1_quartiles(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    return O.quartile_table(train, L.NUMERIC).select("column", "q1", "q3")


@register("o2_iqr_fences", sql=L.with_loans(
    f", qt AS ({_quartile_sql('train', L.NUMERIC)})"
    " SELECT \"column\", q1, q3, q3 - q1 AS iqr, q1 - (q3 - q1) * 1.5 AS lower, q3 + (q3 - q1) * 1.5 AS upper"
    " FROM qt"), rounding=_Q_ROUND)
def o2_iqr_fences(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    return O.quartile_table(train, L.NUMERIC)


def _iqr_count_sql(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM {src}, (SELECT quantile_cont({c}, 0.25) AS q1,"
        f" quantile_cont({c}, 0.75) AS q3 FROM {src}) q WHERE {c} < q1 - (q3 - q1) * 1.5"
        f" OR {c} > q3 + (q3 - q1) * 1.5) AS outlier_count" for c in cols)


@register("o3_iqr_counts", sql=L.with_loans(_iqr_count_sql("train", L.NUMERIC)))
def o3_iqr_counts(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    return O.iqr_outlier_counts(train, L.NUMERIC)


@register("o4_sorted_counts", sql=L.with_loans(_iqr_count_sql("train", L.NUMERIC)))
def o4_sorted_counts(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    return O.sorted_counts(O.iqr_outlier_counts(train, L.NUMERIC))


@register("o5_zscore_counts", sql=L.with_loans(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM train, (SELECT avg({c}) AS m, stddev_pop({c}) AS s"
    f" FROM train) z WHERE ({c} - m) / s > 3) AS outlier_count" for c in L.NUMERIC)))
def o5_zscore_counts(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    return O.zscore_outlier_counts(train, L.NUMERIC)


# ----------------------------------------------------------- tests T1, T4-T8

from loanframe.functions.dist import norm_ppf_sql  # noqa: E402
from loanframe.operators import chartdata as C  # noqa: E402

_CAT_TESTS = L.CATEGORICAL + ["cb_person_default_on_file"]


def _flagged_sql(src="dedup"):
    return f", flagged AS (SELECT *, {_flags_sql()} FROM {src})\n"


def _contingency_sql(rows, cols):
    return " UNION ALL ".join(
        f"SELECT '{r}' AS row_var, '{c}' AS col_var, CAST({r} AS VARCHAR) AS row_level,"
        f" CAST({c} AS VARCHAR) AS col_level, count(*) AS observed FROM flagged"
        f" WHERE {r} IS NOT NULL AND {c} IS NOT NULL GROUP BY 3, 4" for r in rows for c in cols)


@register("t6_contingency", sql=L.with_loans(_flagged_sql() + _contingency_sql(_CAT_TESTS, T2_FLAGS)))
def t6_contingency(spark, sf_dir):
    return T.contingency_long(flagged_dedup(spark, sf_dir), _CAT_TESTS, T2_FLAGS)


@register("t6_crosstab", sql=L.with_loans(_flagged_sql() + (
    "SELECT loan_grade, count_if(NOT pel_missing) AS \"false\", count_if(pel_missing) AS \"true\""
    " FROM flagged GROUP BY loan_grade")))
def t6_crosstab(spark, sf_dir):
    return T.crosstab(flagged_dedup(spark, sf_dir), "loan_grade", "pel_missing", [False, True])


_CHI2_SQL = L.with_loans(_flagged_sql() + ", ct AS (" + _contingency_sql(_CAT_TESTS, T2_FLAGS) + "),\n"
    "nr AS (SELECT row_var, col_var, count(DISTINCT row_level) AS n_rows, count(DISTINCT col_level) AS n_cols"
    " FROM ct GROUP BY 1, 2),\n"
    "e AS (SELECT ct.*, CAST((n_rows - 1) * (n_cols - 1) AS BIGINT) AS dof,"
    " CAST(sum(observed) OVER (PARTITION BY ct.row_var, ct.col_var, row_level) AS DOUBLE)"
    " * sum(observed) OVER (PARTITION BY ct.row_var, ct.col_var, col_level)"
    " / sum(observed) OVER (PARTITION BY ct.row_var, ct.col_var) AS expected FROM ct JOIN nr"
    " ON ct.row_var = nr.row_var AND ct.col_var = nr.col_var)\n"
    "SELECT row_var, col_var, sum(CASE WHEN dof = 1 THEN greatest(abs(observed - expected) - 0.5, 0.0)"
    " ELSE abs(observed - expected) END ^ 2 / expected) AS statistic, max(dof) AS dof FROM e GROUP BY 1, 2")


@register("t7_chi2", sql=_CHI2_SQL, rounding={"statistic": 9})
def t7_chi2(spark, sf_dir):
    return T.chi2_independence(flagged_dedup(spark, sf_dir), _CAT_TESTS, T2_FLAGS).select(
        "row_var", "col_var", "statistic", "dof")


@register("t7_chi2_pvalues")
def t7_chi2_pvalues(spark, sf_dir):
    t = T.chi2_independence(flagged_dedup(spark, sf_dir), _CAT_TESTS, T2_FLAGS)
    return t.withColumn("reject_h0", F.col("p_value") < 0.05)


_PATTERN_SQL = L.with_loans(
    "SELECT " + " + ".join(f"CAST({c} IS NULL AS INT) * {1 << i}" for i, c in enumerate(L.NUMERIC))
    + " AS pattern, count(*) AS n, " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in L.NUMERIC)
    + " FROM dedup GROUP BY 1")


@register("t1_pattern_stats", sql=_PATTERN_SQL, rounding={c: 6 for c in L.NUMERIC})
def t1_pattern_stats(spark, sf_dir):
    return T.pattern_stats(L.deduped(spark, sf_dir), L.NUMERIC)


@register("t1_little_mcar")
def t1_little_mcar(spark, sf_dir):
    r = T.little_mcar(L.deduped(spark, sf_dir), L.NUMERIC)
    return spark.createDataFrame([(float(r["statistic"]), int(r["dof"]), float(r["p_value"]),
                                   bool(r["p_value"] <= 0.05))],
                                 "statistic double, dof bigint, p_value double, reject_h0 boolean")


@register("t4_logit_numeric")
def t4_logit_numeric(spark, sf_dir):
    d = flagged_dedup(spark, sf_dir)
    out = None
    for flag, src in L.FLAG_SOURCES.items():
        preds = [c for c in L.NUMERIC if c != src]
        t = T.logit_summary(d, flag, preds)
        out = t if out is None else out.unionByName(t)
    return out


@register("t5_logit_category")
def t5_logit_category(spark, sf_dir):
    from loanframe.functions import columns as P2
    from loanframe.operators.encode import get_dummies
    d = flagged_dedup(spark, sf_dir)
    d = P2.replace_levels(d, "person_home_ownership", {"OTHER": "MORTGAGE"})
    d = P2.replace_levels(d, "loan_grade", {"G": "F"})
    d = d.withColumn("cb_person_default_on_file", F.col("cb_person_default_on_file").cast("string"))
    dummies = get_dummies(d.select(*T2_FLAGS, *_CAT_TESTS), _CAT_TESTS, drop_first=True)
    preds = [c for c in dummies.columns if c not in T2_FLAGS]
    out = None
    for flag in T2_FLAGS:
        t = T.logit_summary(dummies, flag, preds)
        out = t if out is None else out.unionByName(t)
    return out


def _poly_sql(c: list[float], x: str) -> str:
    return "(" + " + ".join(f"({v!r}) * pow({x}, {k})" for k, v in enumerate(c)) + ")"


def _shapiro_sql(cols: list[str]) -> str:
    """W from the ranks written out; beyond seven standard deviations p is 0 to nine decimals."""
    v = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n"
                           f" FROM train WHERE {c} IS NOT NULL" for c in cols)
    return L.with_loans(
        f", v AS ({v}), m AS (SELECT *, {norm_ppf_sql('((i - 0.375) / (n + 0.25))')} AS m FROM v),"
        " s AS (SELECT col, n, sum(m * m) AS m2, avg(x) AS mean, max(m) AS mn, max(m) FILTER (i = n - 1) AS mn1, 1 / sqrt(n) AS u"
        " FROM m GROUP BY col, n),"
        f" a AS (SELECT *, {_poly_sql(T.SW_C1, 'u')} + mn / sqrt(m2) AS an, {_poly_sql(T.SW_C2, 'u')} + mn1 / sqrt(m2) AS an1 FROM s),"
        " r AS (SELECT *, sqrt((m2 - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)) AS root FROM a),"
        " w AS (SELECT col, r.n, pow(sum((x - mean) * CASE WHEN i = r.n THEN an WHEN i = 1 THEN -an WHEN i = r.n - 1 THEN an1"
        " WHEN i = 2 THEN -an1 ELSE m / root END), 2) / sum((x - mean) * (x - mean)) AS W FROM m JOIN r USING (col) GROUP BY col, r.n),"
        f" z AS (SELECT *, (ln(1 - W) - {_poly_sql(T.SW_C5, 'ln(n)')}) / exp({_poly_sql(T.SW_C6, 'ln(n)')}) AS z FROM w)"
        ' SELECT col AS "column", n, W, CASE WHEN z > 7 THEN 0.0 END AS p_value, n <= 5000 AS p_valid, z > 1.6448536269514722 AS reject_normal FROM z')


@register("t8_shapiro", sql=_shapiro_sql(L.NUMERIC), rounding={"W": 9, "p_value": 9})
def t8_shapiro(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    rows = T.shapiro_wilk_all(train, L.NUMERIC)
    return spark.createDataFrame(
        [(r["column"], int(r["n"]), r["W"], r["p_value"], bool(r["p_valid"]),
          bool(r["p_value"] is not None and r["p_value"] < 0.05)) for r in rows],
        "column string, n bigint, W double, p_value double, p_valid boolean, reject_normal boolean")


# ----------------------------------------------------------- chart data C1, C3, C4

_VIOLIN = [("person_income", "pel_missing"), ("loan_amnt", "pel_missing"),
           ("person_income", "lir_missing"), ("loan_amnt", "lir_missing")]


def _violin_sql():
    parts = []
    for v, g in _VIOLIN:
        qs = ", ".join(f"quantile_cont({v}, {p}) AS q{int(round(p * 100)):02d}" for p in C.VIOLIN_PROBS)
        parts.append(f"SELECT '{v}' AS variable, '{g}' AS by, {g} AS \"group\", count({v}) AS n,"
                     f" min(CAST({v} AS DOUBLE)) AS min, max(CAST({v} AS DOUBLE)) AS max, {qs}"
                     f" FROM flagged GROUP BY {g}")
    return L.with_loans(_flagged_sql() + " UNION ALL ".join(parts))


@register("c1_violin_summary", sql=_violin_sql(),
          rounding={f"q{int(round(p * 100)):02d}": 6 for p in C.VIOLIN_PROBS})
def c1_violin_summary(spark, sf_dir):
    d = flagged_dedup(spark, sf_dir)
    out = None
    for v, g in _VIOLIN:
        t = C.grouped_summary(d, v, g)
        out = t if out is None else out.unionByName(t)
    return out


def _violin_hist_sql(bins=30):
    parts = []
    for v, g in _VIOLIN:
        x = f"CAST({v} AS DOUBLE)"
        mm = f"(SELECT min({x}) AS a, (max({x}) - min({x})) / {bins} AS w FROM flagged) AS mm"
        parts.append(f"SELECT '{v}' AS variable, '{g}' AS by, {g} AS \"group\","
                     f" CAST(least(floor(({x} - a) / CASE WHEN w = 0 THEN 1.0 ELSE w END), {bins - 1}) AS BIGINT) AS bin,"
                     f" count(*) AS count FROM flagged, {mm} WHERE {v} IS NOT NULL GROUP BY ALL")
    return L.with_loans(_flagged_sql() + " UNION ALL ".join(parts))


@register("c1_violin_histogram", sql=_violin_hist_sql())
def c1_violin_histogram(spark, sf_dir):
    d = flagged_dedup(spark, sf_dir)
    out = None
    for v, g in _VIOLIN:
        t = C.grouped_histogram(d, v, g)
        out = t if out is None else out.unionByName(t)
    return out


def _hist_sql(cols, bins=30):
    mm = ", ".join(f"min(CAST({c} AS DOUBLE)) AS a_{c}, max(CAST({c} AS DOUBLE)) AS b_{c}" for c in cols)
    parts = []
    for c in cols:
        w = f"(CASE WHEN b_{c} > a_{c} THEN (b_{c} - a_{c}) / {bins} ELSE 1.0 END)"
        b = f"CAST(least(floor((CAST({c} AS DOUBLE) - a_{c}) / {w}), {bins - 1}) AS BIGINT)"
        parts.append(f"SELECT '{c}' AS variable, {b} AS bin, a_{c} + {b} * {w} AS bin_lo,"
                     f" a_{c} + ({b} + 1) * {w} AS bin_hi FROM train, mm WHERE {c} IS NOT NULL")
    return L.with_loans(f", mm AS (SELECT {mm} FROM train), h AS (" + " UNION ALL ".join(parts) + ")"
                        " SELECT variable, bin, bin_lo, bin_hi, count(*) AS count, 'raw' AS stage FROM h"
                        " GROUP BY ALL")


@register("c3_histogram", sql=_hist_sql(L.NUMERIC), rounding={"bin_lo": 6, "bin_hi": 6})
def c3_histogram(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    return C.histogram(train, L.NUMERIC, 30, "raw")


@register("c3_histogram_stages")
def c3_histogram_stages(spark, sf_dir):
    """Before / Yeo-Johnson / log1p / quantile histograms of the numerics."""
    from loanframe.operators import numeric as N2
    train, _ = L.train_test(spark, sf_dir)
    cols = L.NUMERIC
    yj = N2.YeoJohnson(cols).fit(train).transform(train)
    lg = train.select(*[P.log1p(c).alias(c) for c in cols])
    qt = N2.QuantileTransformer(cols).fit(train).transform(train)
    out = C.histogram(train, cols, 30, "raw")
    for name, d in (("yeo_johnson", yj), ("log1p", lg), ("quantile", qt)):
        out = out.unionByName(C.histogram(d, cols, 30, name))
    return out


def _qq_sql(cols):
    parts = [f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS sample, count(*) AS n FROM train"
             f" WHERE {c} IS NOT NULL GROUP BY ALL" for c in cols]
    return L.with_loans(
        ", v AS (" + " UNION ALL ".join(parts) + "), p AS (SELECT variable, sample, n,"
        " (sum(n) OVER (PARTITION BY variable ORDER BY sample) - n / 2.0) / sum(n) OVER (PARTITION BY variable) AS prob"
        f" FROM v) SELECT variable, sample, n, prob, {norm_ppf_sql('prob')} AS theoretical FROM p")


@register("c4_qq_points", sql=_qq_sql(L.NUMERIC), rounding={"sample": 6, "prob": 12, "theoretical": 9})
def c4_qq_points(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    return C.qq_points(train, L.NUMERIC)
