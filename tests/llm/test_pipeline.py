import corpus_pipeline as C
from loanframe.llm import decontam as D
from loanframe.llm import pieces, quality, toxicity
from loanframe.llm.common import stored, table
from tests.conftest import SF_SMALL
from tests.llm.test_decontam import _brute as hits
from tests.llm.test_neardup import _brute as groups


def test_stages_match_brute_force(spark):
    """Each stage against a plain version on what the stage before it kept."""
    docs = table(spark, SF_SMALL, "documents")
    columns, kept, last = docs.columns, {}, docs
    for name, stage in C.STAGES:
        out = stored(stage(spark, last, SF_SMALL), f"test-{name}")
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        before = {r["doc_id"]: r for r in last.collect()}
        assert out.count() == len(kept[name])
        if name != "sentencepiece":
            assert out.columns == columns
        if name == "toxicity":
            p = {r["doc_id"]: r["score"] for r in toxicity.score(last, toxicity.trained(
                last, table(spark, SF_SMALL, "labels"))).collect()}
            assert set(kept[name]) == {i for i, s in p.items() if s < 0.3}
        elif name == "quality":
            q = {r["doc_id"]: r["score"] for r in quality.score(last, *quality.trained(
                last, table(spark, SF_SMALL, "labels"))).collect()}
            assert set(kept[name]) == {i for i, s in q.items() if s >= 0.5}
        elif name == "near_dedup":
            want = groups([(i, r["text"]) for i, r in before.items()], 5, 80, 100)
            assert set(kept[name]) == {i for i, (_, root) in want.items() if i == root}
        elif name == "decontamination":
            items = [(str(r["item_id"]), D.words_of(r["text"].encode()))
                     for r in table(spark, SF_SMALL, "benchmark").collect()]
            for i, r in before.items():
                words = D.words_of((r["text"] or "").encode())
                hit, _ = hits(words, items, 10)
                assert (i in kept[name]) == (len(hit) <= 0.5 * len(words))
                if i in kept[name]:
                    left = D.words_of((kept[name][i]["text"] or "").encode())
                    assert left == [w for k, w in enumerate(words) if k not in hit]
        else:
            assert {i: r["text"] for i, r in kept[name].items()} == {i: r["text"] or "" for i, r in before.items()}
        if name != "sentencepiece" and name != "decontamination":
            assert all(kept[name][i] == before[i] for i in kept[name])
        last = out
    assert len(kept["sentencepiece"]) > 50


def test_empty_tables_nulls_and_clashing_columns(spark):
    schema = "doc_id long, text string, score double, label string, `odd name` string"
    for rows in ([], [(1, None, 0.1, "x", "y"), (2, "", 0.2, None, None), (None, "some text here", None, "x", "y"),
                      (3, "plain words " * 40, 0.5, "a", "b"), (3, "plain words " * 40, 0.5, "a", "b")]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in C.STAGES:
            docs = stored(stage(spark, docs, SF_SMALL), f"test-{name}")
            if name != "sentencepiece":
                assert docs.columns == ["doc_id", "text", "score", "label", "odd name"]
        out = docs.collect()
        assert docs.columns == ["doc_id", "text", "ids", "n_pieces", "score", "alternatives"]
        assert not rows and not out or {r["doc_id"] for r in out} <= {1, 2, 3, None}


def test_pipeline_returns_the_alternatives(spark, monkeypatch):
    monkeypatch.setattr(C, "STAGES", C.STAGES[-1:])
    got = {r["doc_id"]: r for r in C.run(spark, SF_SMALL).collect()}
    enc = pieces.vocabulary().encoder(3)
    for r in table(spark, SF_SMALL, "documents").collect():
        _, score, others = enc.encode(r["text"] or "")
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-6
        assert [a["score"] for a in got[r["doc_id"]]["alternatives"]] == [s for s, _ in others]
    assert sum(len(r["alternatives"]) == 2 for r in got.values()) > 50
