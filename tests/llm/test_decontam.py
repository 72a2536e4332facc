import random
import re
import time

from loanframe.llm import decontam as D


def _brute(words, items, n):
    hit, found = set(), set()
    for key, ws in items:
        m = min(n, len(ws))
        grams = {tuple(ws[i:i + m]) for i in range(len(ws) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if tuple(words[i:i + m]) in grams:
                hit |= set(range(i, i + m))
                found.add(key)
    return hit, found


def test_automaton_matches_brute_force():
    rnd = random.Random(5)
    for trial in range(150):
        n = rnd.choice([1, 2, 3, 5])
        items = [(str(k), [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.choice([0, 1, 2, 3, 4, 9, 14]))])
                 for k in range(rnd.randint(0, 6))]
        auto = D.Automaton(items, n)
        words = [rnd.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(rnd.choice([0, 1, 7, 40]))]
        longest, spans, found = auto.search(words)
        hit, want = _brute(words, items, n)
        assert {i for a, b in spans for i in range(a, b + 1)} == hit and found == want, (trial, items, words)
        assert all(x[1] + 1 < y[0] for x, y in zip(spans, spans[1:]))
        every = {tuple(ws[i:j]) for _, ws in items for i in range(len(ws)) for j in range(i + 1, len(ws) + 1)}
        assert longest == max([j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1)
                               if tuple(words[i:j]) in every], default=0)


def test_repeated_words_are_linear():
    """Items and texts of one word over and over: no climbing from state to state at every word."""
    items = [("long", [b"a"] * 4000), ("short", [b"a"] * 3), ("other", [b"a", b"b"])]
    began = time.time()
    auto = D.Automaton(items, 10)
    longest, spans, found = auto.search([b"a"] * 60_000 + [b"b"])
    assert longest == 4000 and spans == [(0, 60_000)] and found == {"long", "short", "other"} and time.time() - began < 3


ITEM = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu"


def _tables(spark):
    docs = [(1, f"Intro text here. {ITEM.upper()} and more that goes on for a good while after the passage ends now", "x"),
            (2, ITEM, "x"), (3, "alpha beta gamma delta", "x"), (4, None, "x"), (5, "", "x"),
            (6, "says é-Hello, WORLD... twice é hello world", "x"), (6, "says é-Hello, WORLD... twice é hello world", "x"),
            (None, "z " * 30_000 + ITEM, "x")]
    items = [(10, ITEM), (9, "É hello world"), (11, "é hello world"), (12, None), (13, "..."), (14, ITEM)]
    return (spark.createDataFrame(docs, "doc_id long, text string, items string"),
            spark.createDataFrame(items, "item_id long, text string"))


def test_report_and_edges(spark, monkeypatch):
    docs, items = _tables(spark)
    one = sorted(map(str, D.report(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 30)                     # many blocks
    assert one == sorted(map(str, D.report(docs, items).collect()))
    rows = {r["doc_id"]: r for r in D.report(docs, items).collect()}
    assert rows[2]["n_hit"] == 12 and rows[2]["n_items"] == 2 and rows[3]["n_hit"] == 0
    assert rows[4]["n_words"] == rows[5]["n_words"] == 0 and not rows[4]["contaminated"]
    assert rows[6]["n_words"] == 8 and rows[6]["n_hit"] == 6 and rows[6]["n_items"] == 1
    assert rows[None]["n_words"] == 30_012 and rows[None]["n_hit"] == 12
    none = D.report(docs, items.limit(0)).collect()
    assert len(none) == 8 and not any(r["contaminated"] for r in none)
    assert D.report(docs.limit(0), items).count() == 0


def test_decontaminate_cuts_and_drops(spark):
    docs, items = _tables(spark)
    out = {r["doc_id"]: r for r in D.decontaminate(docs, items).collect()}
    assert 2 not in out and 6 not in out and out[4]["text"] is None and out[5]["text"] == ""
    assert out[1]["text"] == "Intro text here.  and more that goes on for a good while after the passage ends now"
    assert out[None]["text"] == "z " * 30_000 and out[3]["text"] == "alpha beta gamma delta"
    assert out[1]["items"] == "x" and list(out[1].asDict()) == docs.columns
    assert re.fullmatch("(z )*", out[None]["text"])
