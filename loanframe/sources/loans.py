"""The loan table, derived from the driver's ``orders`` and ``customer``.

The reference reads a loan CSV that is not in its tree.  This view has the
columns its code names, nulls that depend on balance in one column (MAR) and
are random in another (MCAR), outliers, exact duplicates and an unbalanced
label.  ``LOAN_CTE`` is the same view as portable SQL for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.sources import io

NUMERIC = ["person_age", "person_income", "person_emp_length", "loan_amnt", "loan_int_rate"]
CATEGORICAL = ["person_home_ownership", "loan_intent", "loan_grade"]
FLAG_SOURCES = {"pel_missing": "person_emp_length", "lir_missing": "loan_int_rate"}
LABEL = "loan_status"
KEY = "loan_id"
TEST_FRACTION_PER_MILLE = 300
SPLIT_SEED = 42


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return io.read_table(spark, f"{sf_dir}/{name}.parquet")


def loan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loan per order (no duplicates)."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey)
    ok, ck, bal = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_acctbal")
    income = (bal + F.lit(2000.0)) * F.when(ck % 50 == 0, F.lit(20.0)).otherwise(F.lit(1.0))
    amount = F.col("o_totalprice") / F.lit(10.0)
    return j.select(
        ok.alias("loan_id"),
        (F.lit(18) + (ck * 7) % 60).cast("bigint").alias("person_age"),
        income.alias("person_income"),
        F.when(F.col("c_nationkey") % 4 == 0, "RENT")
        .when(F.col("c_nationkey") % 4 == 1, "MORTGAGE")
        .when(F.col("c_nationkey") % 4 == 2, "OWN")
        .otherwise("OTHER").alias("person_home_ownership"),
        F.when((bal < 500.0) & (ok % 2 == 0), F.lit(None).cast("double"))
        .otherwise(((ck * 11) % 40).cast("double")).alias("person_emp_length"),
        F.col("o_orderpriority").alias("loan_intent"),
        F.substring(F.lit("ABCDEFG"), (F.lit(1) + (ok * 13) % 7).cast("int"), 1).alias("loan_grade"),
        amount.alias("loan_amnt"),
        F.when((ok * 7919) % 10007 < 900, F.lit(None).cast("double"))
        .otherwise(F.lit(5.0) + ((ok * 31) % 64).cast("double") / F.lit(4.0)).alias("loan_int_rate"),
        (bal < 0.0).alias("cb_person_default_on_file"),
        ((amount / (bal + F.lit(2000.0)) > 8.0) != ((ok * 104729) % 1009 < 60)).alias("loan_status"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan table with its exact duplicates (every 97th loan twice).

    The copies come from one ``explode`` over the joined rows, so the join
    runs once; the oracle writes the same multiset as a UNION ALL.
    """
    base = loan_base(spark, sf_dir)
    copies = F.when(F.col("loan_id") % 97 == 0, F.lit(2)).otherwise(F.lit(1))
    return (base.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
            .drop("_copy"))


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 applied to the loan table: the frame all later steps start from."""
    return loans(spark, sf_dir).dropDuplicates()


def is_test(key: Column | str = KEY, seed: int = SPLIT_SEED,
            per_mille: int = TEST_FRACTION_PER_MILLE) -> Column:
    """Hash split on the key: same rows on any cluster and in DuckDB."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"))), 1, 8), 16, 10)
    return h.cast("bigint") % 1000 < per_mille


def is_test_sql(key: str = KEY, seed: int = SPLIT_SEED,
                per_mille: int = TEST_FRACTION_PER_MILLE) -> str:
    return (f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"
            f" % 1000 < {per_mille})")


def with_flags(df: DataFrame) -> DataFrame:
    """Null flags of the two columns with missing values."""
    return df.withColumns({f: F.col(c).isNull() for f, c in FLAG_SOURCES.items()})


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = deduped(spark, sf_dir)
    t = is_test()
    return d.filter(~t), d.filter(t)


# Portable SQL of the same view (DuckDB side of the oracle).  ``loans``
# has the duplicates, ``dedup`` is D3, ``train``/``test`` the hash split.
LOAN_CTE = f"""
base AS (
  SELECT o.o_orderkey AS loan_id,
    CAST(18 + (o.o_custkey * 7) % 60 AS BIGINT) AS person_age,
    (c.c_acctbal + 2000.0) * CASE WHEN o.o_custkey % 50 = 0 THEN 20.0 ELSE 1.0 END AS person_income,
    CASE c.c_nationkey % 4 WHEN 0 THEN 'RENT' WHEN 1 THEN 'MORTGAGE'
                           WHEN 2 THEN 'OWN' ELSE 'OTHER' END AS person_home_ownership,
    CASE WHEN c.c_acctbal < 500.0 AND o.o_orderkey % 2 = 0 THEN NULL
         ELSE CAST((o.o_custkey * 11) % 40 AS DOUBLE) END AS person_emp_length,
    o.o_orderpriority AS loan_intent,
    substr('ABCDEFG', CAST(1 + (o.o_orderkey * 13) % 7 AS INT), 1) AS loan_grade,
    o.o_totalprice / 10.0 AS loan_amnt,
    CASE WHEN (o.o_orderkey * 7919) % 10007 < 900 THEN NULL
         ELSE 5.0 + CAST((o.o_orderkey * 31) % 64 AS DOUBLE) / 4.0 END AS loan_int_rate,
    (c.c_acctbal < 0.0) AS cb_person_default_on_file,
    ((o.o_totalprice / 10.0 / (c.c_acctbal + 2000.0) > 8.0)
      <> ((o.o_orderkey * 104729) % 1009 < 60)) AS loan_status
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
loans AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE loan_id % 97 = 0),
dedup AS (SELECT DISTINCT * FROM loans),
train AS (SELECT * FROM dedup WHERE NOT {is_test_sql()}),
test AS (SELECT * FROM dedup WHERE {is_test_sql()})
"""


def with_loans(select_sql: str) -> str:
    """Prefix an oracle query with the loan view CTEs."""
    return f"WITH {LOAN_CTE.strip()}\n{select_sql}"
