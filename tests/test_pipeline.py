from pyspark.sql import functions as F

from loanframe.plans import pipelines as PL
from loanframe.plans.catalog import load_all
from loanframe.session import ensure_checkpoint_dir
from loanframe.sources import io
from loanframe.sources import loans as L
from tests.conftest import SF_SMALL


def test_tree_pipeline_fit_save_load_same_rows(spark):
    train, test = L.train_test(spark, SF_SMALL)
    model = PL.fit_pipeline("tree", train)
    names = PL.feature_names(model)
    out = PL.transform(model, test)
    assert out.filter(F.size("features") != len(names)).count() == 0
    path = f"{ensure_checkpoint_dir(spark)}/test-pipeline-tree"
    io.save_pipeline(model, path)
    again = PL.transform(io.load_pipeline(path), test)
    assert out.exceptAll(again).count() == 0 and again.exceptAll(out).count() == 0
    # numeric features carry no NULLs after imputation, category dummies are 0/1
    wide = PL.expand(out, names)
    assert wide.select([F.count_if(F.col(f"`{c}`").isNull()) for c in names]).first() == tuple([0] * len(names))


def test_feature_queries_return_both_halves(spark):
    train, test = L.train_test(spark, SF_SMALL)
    want = {(r[L.KEY], n) for n, d in (("train", train), ("test", test)) for r in d.select(L.KEY).collect()}
    got = [(r[L.KEY], r["split"]) for r in load_all()["l2_tree_features"].spark_df(spark, SF_SMALL).select(L.KEY, "split").collect()]
    assert set(got) == want and len(got) == train.count() + test.count() and {n for _, n in got} == {"train", "test"}
