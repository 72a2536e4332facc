import random
import re

from loanframe.llm import licenses as L
from loanframe.llm import queries as Q
from tests.conftest import SF_SMALL


def _words(text):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x]


def _grams(text, width=5):
    w = _words(text)
    return [tuple(w[i:i + width]) for i in range(len(w) - width + 1)]


def _brute(text, templates):
    """License -> best containment over every place of the text."""
    h, out = _grams(text), {}
    for lic, t in templates:
        if 0 < len(_words(t)) < 5:
            if tuple(_words(t)) in _grams(text, len(_words(t))):
                out[lic] = 1.0
            continue
        g = _grams(t)
        s, half = len(g), (len(g) + 1) // 2
        if not s:
            continue
        best = max((len(set(g) & set(h[max(0, i - half):i + s + half])) / len(set(g)) for i in range(len(h))), default=0)
        if best >= 0.8:
            out[lic] = max(out.get(lic, 0), best)
    return out


def _rows(df):
    return {(r["doc_id"], r["license_id"]): r for r in df.collect()}


def test_finds_what_brute_force_finds(spark):
    rnd = random.Random(8)
    words = ["w%d" % i for i in range(300)]
    docs = []
    for i in range(120):
        text = [rnd.choice(words) for _ in range(rnd.choice([0, 3, 40, 400]))]
        for _ in range(rnd.choice([0, 1, 2])):
            t = rnd.choice(L.TEMPLATES)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            at = rnd.randint(0, len(text))
            text[at:at] = [x.upper() if rnd.random() < 0.2 else x for x in t]
        docs.append((i, " # ".join(text), "x"))
    df = spark.createDataFrame(docs, "doc_id long, text string, license_id string")
    got = _rows(L.scan(df, L.default_templates(spark)))
    want = {(i, lic): c for i, text, _ in docs for lic, c in _brute(text, L.TEMPLATES).items()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r["containment"] <= want[k] + 1e-9 and r["containment"] >= 0.8


def test_whole_documents_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {(r["doc_id"], lic) for r in docs for lic in _brute(r["text"], L.TEMPLATES)}
    got = _rows(Q.op6_license_scan(spark, SF_SMALL))
    assert set(got) == want and want


def test_edges(spark):
    line = "Released under the MIT License."
    long = "x " * 50_000 + line + " y" * 50_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, line), (3, line), (4, long), (None, line), (5, "a b c"), (6, (line + "\n") * 300)],
                               "doc_id long, text string")
    got = _rows(L.scan(df, L.default_templates(spark)))
    assert set(got) == {(3, "mit"), (4, "mit"), (None, "mit"), (6, "mit")}
    assert got[3, "mit"]["n_windows"] == 1 and got[4, "mit"]["first_word"] == 50_000 and got[6, "mit"]["n_windows"] == 300
    none = L.default_templates(spark).where("template_id < 0")
    assert L.scan(df, none).count() == 0 and L.scan(df.limit(0), L.default_templates(spark)).count() == 0
    short = spark.createDataFrame([(0, "s", "a B"), (1, "n", None), (2, "e", "..."), (3, "one", "c"), (4, "two", "b c d")],
                                  "template_id int, license_id string, text string")
    got = _rows(L.scan(df, short))
    assert set(got) == {(5, "s"), (5, "one")} and got[5, "one"]["first_word"] == 2 and got[5, "s"]["n_windows"] == 1


def test_reserved_rights_are_found(spark):
    """The three-word notice, by a search of its own."""
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {r["doc_id"] for r in rows if re.search(r"(?<![a-z0-9\x80-\U0010ffff])all[\x00-\x2F\x3A-\x60\x7B-\x7F]+rights"
                                                   r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+reserved(?![a-z0-9\x80-\U0010ffff])", (r["text"] or "").lower())}
    got = {r["doc_id"] for r in Q.op6_license_scan(spark, folder).where("license_id = 'all-rights-reserved'").collect()}
    assert got == want and len(want) >= 7
