import duckdb
import numpy as np

from loanframe.functions import dist


def test_published_tail_values():
    assert abs(dist.t_sf2(2.228, 10) - 0.05) < 1e-3
    assert abs(dist.chi2_sf(5.991, 2) - 0.05) < 1e-3
    assert abs(dist.chi2_sf(3.841, 1) - 0.05) < 1e-3
    assert abs(dist.t_sf2(0.0, 5) - 1.0) < 1e-12


def test_as241_round_trip():
    p = np.array([1e-12, 1e-6, 0.01, 0.2, 0.5, 0.7, 0.975, 1 - 1e-9])
    assert np.max(np.abs(dist.norm_cdf(dist.norm_ppf(p)) - p) / p) < 1e-9


def test_as241_sql_same_in_duckdb():
    ps = [0.001, 0.1, 0.3, 0.5, 0.9, 0.99999]
    con = duckdb.connect()
    got = [con.execute(f"SELECT {dist.norm_ppf_sql(repr(p))}").fetchone()[0] for p in ps]
    assert np.allclose(got, dist.norm_ppf(ps), rtol=1e-13, atol=1e-13)


def test_as241_column_in_spark(spark):
    from pyspark.sql import functions as F
    ps = [0.001, 0.1, 0.3, 0.5, 0.9, 0.99999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(dist.norm_ppf_col(F.col("p"))).collect()]
    assert np.allclose(got, dist.norm_ppf(ps), rtol=1e-13, atol=1e-13)
