import duckdb

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem".split()
CHEAP = ["t2_welch", "d4_shape", "n2_null_counts", "o3_iqr_counts", "e3_onehot_if_binary",
         "k1_roc_auc", "k2_roc_curve", "t7_chi2", "i7_kbins"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 6
    assert set(df.columns) >= {"feature", "flag", "t_stat", "dof"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for _, r in pdf.iterrows():
        row = []
        for c in cols:
            v = r[c]
            if isinstance(v, float):
                v = None if v != v else round(v, 9)
            row.append(v)
        out.append(tuple(row))
    return cols, sorted(out, key=repr)


def test_cheap_queries_match_duckdb(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    q, sql = E.queries(), E.oracle_sql()
    for name in CHEAP:
        a = _rows(q[name](spark, SF_SMALL).toPandas())
        b = _rows(con.execute(sql[name]).fetchdf())
        assert a == b, name


def test_partition_independence(spark):
    from loanframe.operators import stattests as T
    from loanframe.sources import loans as L
    d = L.with_flags(L.deduped(spark, SF_SMALL))
    a = T.welch_stats(d.repartition(1), ["person_income"], ["pel_missing"]).first()
    b = T.welch_stats(d.repartition(13), ["person_income"], ["pel_missing"]).first()
    assert a["n_obs"] == b["n_obs"] and abs(a["t_stat"] - b["t_stat"]) < 1e-9
