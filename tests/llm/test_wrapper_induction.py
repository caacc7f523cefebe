"""Main text of planted sites, the matching against brute force, and the whole pages table against an independent reading of its one layout."""

import html
import itertools
import os
import random
import re

import pytest

from millrace.llm import queries, wrapper_induction as wi

SCHEMA = "page_id long, url string, html string, host string, text string, wrapper string, k0 string"
DATA = "/root/testdata/sf0.01"


def extract(spark, rows):
    pages = spark.createDataFrame([(i, u, h, "a", "b", "c", "d") for i, u, h in rows], SCHEMA).repartition(3)
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in wi.extract(pages, ["page_id", "url"]).collect()}


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def sites():
    """Pages of hosts without any telling markup but for one, and their main texts: what varies, without link lists and what is the same everywhere."""
    rnd, rows, want = random.Random(4), [], {}
    for k in range(30):
        body = [words(rnd, rnd.randint(20, 60)) for _ in range(rnd.randint(1, 6))]
        title = words(rnd, 4)
        soup = f"<html><head><title>{title}</title></head><body><div><b>Acme</b> daily</div><div><div><a href=/>Home</a> <a href=/n>News</a></div></div><div><h2>{title}</h2>"
        soup += "".join(f"<p>{b}" for b in body) + "<p>All rights reserved.</div><section>Made by Acme</section>"
        rows.append((k, f"http://Soup.example/{k}", soup))
        want[k] = "\n\n".join([title, *body])
        marked = f"<title>{title}</title><header><h1>Site</h1></header><nav>{words(rnd, 5)}</nav><main><header><h1>{title}</h1></header>" + "".join(f"<p>{b}</p>" for b in body)
        marked += f"<aside>{words(rnd, 9)}</aside><div class='share-buttons'>{words(rnd, 3)}</div><form><p>Mail?</p></form></main><div id=comments><article class=comment><p>{words(rnd, 8)}</p></article></div><script>var x='<p>no</p>'</script><!-- <p>no</p> --><footer>{words(rnd, 4)}</footer>"
        rows.append((100 + k, f"https://u@marked.example:80/{k}", marked))
        want[100 + k] = "\n\n".join([title, *body])
    copies = "<title>same</title><div><p>one text</p><p>another, of a copied page</p></div>"
    rows += [(200 + k, "http://copies.example/", copies) for k in range(40)]
    want |= {200 + k: "one text\n\nanother, of a copied page" for k in range(40)}
    return rows, want


def test_template_goes_and_content_stays(spark):
    rows, want = sites()
    assert {i: t for i, (t, _) in extract(spark, rows).items()} == want


def test_wrappers_by_shuffle_give_the_same(spark, monkeypatch):
    rows, want = sites()
    monkeypatch.setattr(wi, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(wi, "HOT_SHARE", 3)
    assert {i: t for i, (t, _) in extract(spark, rows).items()} == want
    monkeypatch.setattr(wi, "HELD_NODES", 5)
    assert {i: t for i, (t, _) in extract(spark, rows).items()} == want


def test_hard_pages(spark):
    deep, long = "<div>" * 3_000 + "deep" + "</div>" * 3_000, "<article>" + "<h2>t<p>word " * 20_000 + "</article>"
    rows = [
        (1, "http://h/1", None), (2, "http://h/2", ""), (3, None, "<p>no\n\t host</p>"), (4, "nonsense", "<p>a &amp; b &#233; &am &lt;p&gt; &#0;</p><p></p><p> \n </p>"), (5, "http://h/5", deep), (6, "http://h/6", long),
        (7, "http://h/7", "<p>x<!-- open <p>y"), (8, "http://h/8", "<p>x<script>y"), (9, "http://h/9", "<p>x</b></div><li>y<li>z<br>w <a title='>'>q</a"), (10, "http://h/10", '<p title="x>one</p><p>two</p>'), (11, "http://h/11", "<table><tr><td>a<td>b<tr><td>c</table><p>1<p>2<"),
        (11, "http://h/11", "<table><tr><td>a<td>b<tr><td>c</table><p>1<p>2<"), (None, "http://h/12", "<article><p><b>lead<br><p>body</p></article>"), (13, "http://h/13", "<body class='has-sidebar no-ads'><form><div>all in a form " + "w " * 50 + "</div></form>"),
    ]
    got = extract(spark, rows)
    assert got[1] == got[2] == ("", 0) and got[3][0] == "no host" and got[4][0] == "a & b é &am <p> �" and got[5][0] == "deep"
    assert got[6] == ("\n\n".join(["t", "word"] * 20_000), 20_000 * 9 - 2) and got[7][0] == got[8][0] == "x" and got[9][0] == "x\n\ny\n\nz w q"
    assert got[10][0] == "one\n\ntwo" and got[11][0] == "a\n\nb\n\nc\n\n1\n\n2<" and got[None][0] == "lead\n\nbody" and got[13][0].startswith("all in a form")
    assert extract(spark, []) == {}


def random_tree(rnd, size):
    kids = []
    while size > 1 and len(kids) < 3:
        n = rnd.randint(1, size - 1)
        kids.append(random_tree(rnd, n))
        size -= n
    return [rnd.choice("ab"), kids, 1, None]


def plain_matched(a, b):
    """Tree matching by trying all ordered selections of children."""
    if a[0] != b[0]:
        return 0
    best = 0
    for n in range(min(len(a[1]), len(b[1])) + 1):
        for x in itertools.combinations(a[1], n):
            for y in itertools.combinations(b[1], n):
                best = max(best, sum(plain_matched(u, v) for u, v in zip(x, y, strict=True)))
    return 1 + best


def test_tree_matching_is_the_best_one():
    rnd = random.Random(9)
    for _ in range(300):
        a, b = random_tree(rnd, rnd.randint(1, 9)), random_tree(rnd, rnd.randint(1, 9))
        assert wi.matched(a, b, {}) == plain_matched(a, b)


def test_wrappers_stay_bounded(monkeypatch):
    monkeypatch.setattr(wi, "WRAPPER_NODES", 30)
    page = lambda k: wi.Page(f"<title>{k}</title><div><p>same</p></div>" + "".join(f"<div class=c{chr(97 + (k * j) % 26)}><p>text of {k}</p></div>" for j in range(8)))
    held = wi.wrapper_of(page(0))
    for k in range(1, 60):
        held = wi.pruned(wi.merge(held, wi.wrapper_of(page(k))))
        assert wi.nodes_of(held) <= 30
    assert "same" in [page(5).texts[i] for i in wi.template_leaves(held, page(5))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_pages_table_keeps_each_article_whole(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op13_wrapper_induction(spark, DATA).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
