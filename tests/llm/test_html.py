import html as entities
import random
import re

from loanframe.llm import html as H
from loanframe.llm import queries as Q
from tests.conftest import SF_SMALL


def _text(page):
    lines = H._kept(H.lines_of(page))
    zone = H.MAIN if any(z == H.MAIN for z, _ in lines) else H.PLAIN
    return "\n\n".join(t for z, t in lines if z == zone)


def test_common_lines_is_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(300):
        a = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 14))]
        b = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 14))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = H.common_lines(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_lines_and_zones():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><article>"</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
    <!-- ad --><div class="ad-box">Buy</div><div class="cookie notice">We use</div>
    <article class="post"><header class="entry-header"><h1>Head &amp; tail</h1></header>
    <p><b>One<br>two   <i>three</i><p>Four &lt;b&gt; &#233;&nbsp;x<ul><li>item a<li>item <a href='a>b'>b</a></ul>
    <aside>aside</aside><div class="share social">Share</div><form><label>Mail</label><input name=q></form>
    <table><tr><td>c1<td>c2</table><p>last</article>
    <section id="comments"><article class="comment"><p>Troll</p></article></section>
    <p>after</p><footer>&copy; me</footer></body></html>"""
    assert _text(page) == "\n\n".join(["Head & tail", "One two three", "Four <b> é x", "item a", "item b", "c1", "c2", "last"])
    assert _text("plain &amp; text") == "plain & text"
    assert _text(None) == _text("") == _text("<p></p> <br>") == ""
    assert _text("<main><p>m</p></main><p>out") == "m"
    assert _text("<p>a<span class=ad>x</span>b</p><script>never closed") == "a\n\nb"
    assert _text("1 < 2 <3 and <p>ok < fine") == "1 < 2 <3 and\n\nok < fine"
    assert _text("<p>" * 3000 + "deep" + "<div>" * 3000) == "deep"


def _site(n, host="h.example", menu=("Home News Shop", "About us today"), start=0):
    rows = []
    for i in range(n):
        body = [f"Title number {start + i} of the page", f"Own words {i * 7919 % 1009} with something said {i}", f"More {i} at the end"]
        lines = [menu[0], *body[:2], menu[1], body[2], "All rights reserved by us"]
        rows.append((start + i, f"http://{host}/a/{1000 + i}.html", "".join(f"<div>{x}</div>" for x in lines), "\n\n".join(body)))
    return rows


def test_differencing_deletes_what_neighbours_share(spark):
    rows = _site(60) + _site(9, "www.other.example", ("Start", "Impressum"), 100) + _site(1, "alone.example", start=200)
    copy = rows[5]
    rows += [(300, copy[1] + "?utm=1", copy[2], copy[3]), (301, copy[1], copy[2], copy[3]), (5, copy[1], copy[2], copy[3])]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h, _ in rows] + [(400, None, None, "x"), (None, "", "", "x")],
                               "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["url"] or "", r["text"], r["n_chars"]) for r in H.report(df.repartition(7)).collect())
    alone = "\n\n".join(["Home News Shop", *rows[69][3].split("\n\n")[:2], "About us today", rows[69][3].split("\n\n")[2],
                         "All rights reserved by us"])
    want = [(str(i), u, t if i != 200 else alone) for i, u, _, t in rows] + [("400", "", ""), ("None", "", "")]
    assert [g[:3] for g in got] == sorted(want) and all(g[3] == len(g[2]) for g in got)
    assert H.report(df.limit(0)).count() == 0


def test_articles_may_share_lines(spark):
    page = "<nav>{0}</nav><article><h1>Same</h1><p>Same words</p><p>{0}</p></article><p>Same foot</p>"
    df = spark.createDataFrame([(i, f"http://h/p/{i}", page.format(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r["text"] for r in H.main_text(df).collect()} == {f"Same\n\nSame words\n\n{i}" for i in range(8)}


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in Q.op4_html_text(spark, SF_SMALL).collect()}
    assert len(got) == len(pages)
    for r in pages:
        article = re.search("<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = re.split("</?(?:h1|p)>", article)
        want = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        assert got[r["page_id"]] == "\n\n".join(b for b in want if b)


def test_differencing_judges_the_articles_of_a_page(spark):
    """A teaser that every page has in an article element is template; an article with lines of its own is whole."""
    page = ("<article><h1>Title {0}</h1><p>Quoted by all</p><p>Own {0}</p></article><p>between</p>"
            "<article><h2>Read next</h2><p>Ten ways</p></article><article class=comment><p>Troll {0}</p></article>")
    df = spark.createDataFrame([(i, f"http://h/p/{i}", page.format(i)) for i in range(9)] + [
        (20, "http://alone/p", page.format(20))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.main_text(df.repartition(3)).collect()}
    assert got == {i: f"Title {i}\n\nQuoted by all\n\nOwn {i}" for i in range(9)} | {
        20: "Title 20\n\nQuoted by all\n\nOwn 20\n\nRead next\n\nTen ways"}
    assert H._template([1, 1, 2, 2], [0, 1, 2, 3]) == [] and H._template([1, 1, 2, -1, 0], [0, 2, 4]) == [2, 4]
