"""HTML extraction: known pages, hosts with templates that no tag name gives away, and classes against plain vectors."""

import html
import random
import re
from collections import Counter, defaultdict

import pytest

from runforge.llm import html_text as ht
from runforge.llm import queries
from runforge.llm.common import table

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def article(page):
    """Headings and paragraphs of the generator's one <article>."""
    inside = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
    texts = (" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in parts)
    return "\n\n".join(x for x in texts if x)


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_gives_every_article(spark, sf):
    want = sorted((r.page_id, r.url, article(r.html), len(article(r.html))) for r in table(spark, sf, "pages").collect())
    assert sorted(tuple(r) for r in queries.QUERIES["op13_html_extraction"](spark, sf).select("page_id", "url", "text", "n_chars").collect()) == want


CASES = {
    "": "", "   ": "", "just text &amp; more": "just text & more", "<p>one<p>two<br>lines &lt;b&gt; &#233;&nbsp;&copy x": "one\n\ntwo lines <b> é © x",
    "<p>a <b>bold<p>next</b> on</p>": "a bold\n\nnext on",
    "<ul class=menu><li>no</ul><h1>T</h1><p>yes</p><!-- <p>no --><script>'<p>no</p>'</script><style>p</style><p title='a>b'>and</p>": "T\n\nyes\n\nand",
    "<HEADER>no</HEADER><MAIN><h1>T</h1><DIV>yes</DIV></MAIN><FOOTER>no": "T\n\nyes",
    "<article><header><h1>T</h1></header><p>yes</p><footer>no</footer><section id='reader-comments'><p>no</p></section></article>": "T\n\nyes",
    "<div role='navigation'>no</div><p>yes yes</p><div style='display: none'>no</div><div hidden>no</div><form>no<p>no</p></form>": "yes yes",
    "<div class='cookieNotice'>no</div><aside>no</aside><p>yes yes</p><ul><li><a href='/x'>no</a></li></ul><ul><li>in <a>yes</a></ul>": "yes yes\n\nin yes",
    "<p>unclosed <a href='x'>link": "unclosed link", "<table><tr><td>a<td>b<tr><td>c</table>": "a\n\nb\n\nc", "a < b and <3 <": "a < b and <3 <",
    "<div class='ad'>only this</div>": "only this", "<p>" + "long text, " * 50_000 + "</p>": ("long text, " * 50_000).strip(),
    "<div>" * 3000 + "deep": "deep", "<div>short</div><div>" + "the longest of them " * 9 + "</div>": "short\n\n" + ("the longest of them " * 9).strip(), "<title>x</title><body class='has-sidebar'><p>yes</p>": "yes", "<p>cut off in a tag <a href='": "cut off in a tag",
}


def test_pages_by_themselves(spark):
    rows = [(k, f"http://h{k}.example.com/", page) for k, page in enumerate(CASES)] + [(None, None, None), (3, "no url", "<p>x</p>"), (3, "no url", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "'x' as host", "2 as main", "'t' as text", "3 as token")
    got = [tuple(r) for r in ht.extract(df.repartition(3)).collect()]
    want = [(i, u, CASES.get(p, "x") if p is not None else "") for i, u, p in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ht.extract(df.limit(0)).count() == 0


def site(n, seed):
    """Pages of one host whose menu, notice, teaser and article are nameless elements; some texts are on every page."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(n):
        paragraphs = [" ".join(word() for _ in range(rng.randrange(20, 60))) for _ in range(rng.randrange(1, 6))]
        title = f"{word()} {word()}"
        page = ("<html><body><div><span>Welcome to our site</span></div><div><div>Read more: " + word() + "</div></div>"
                f"<div><h1>{title}</h1><div>Please log in to vote</div>" + "".join(f"<p>{p}</p>" for p in paragraphs)
                + "<div>All rights reserved</div></div><div>" + word() + "</div></body></html>")
        rows.append((k, f"https://user@Site.example.com:80/{k}?x", page, "\n\n".join([title, *paragraphs])))
    return rows


def test_template_of_a_host(spark):
    rows = site(40, 1) + [(100 + k, f"http://few.example.com/{k}", "<body><p>Same text in few pages.</p></body>", "Same text in few pages.") for k in range(5)]
    rows += [(200 + k, "http://copies.example.com/", "<body><div>x</div><article><p>One page, many copies.</p></article></body>", "One page, many copies.") for k in range(30)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in ht.extract(df).collect()}
    assert got == {r[0]: r[3] for r in rows}
    found = ht.templates(ht._pages(df, "page_id", "url", "html")).collect()
    assert len(found) == 2
    base = max(found, key=lambda r: len(r.texts))
    assert len(base.texts) == 3 and any(c.parent != 0 for c in base.classes) or len(base.classes) == 1


def test_classes_are_equal_vectors(spark):
    pages = ht._pages(table(spark, SF01, "pages"), "page_id", "url", "html")
    reader, of = ht.Reader(), defaultdict(list)
    for r in pages.collect():
        of[r.host].append(Counter(p.token for p in reader.read(r.html)))
    want = {}
    for host, counts in of.items():
        if len(counts) >= 4:
            groups = defaultdict(set)
            for token in set().union(*counts):
                vector = tuple(c[token] for c in counts)
                if 2 * sum(x > 0 for x in vector) >= len(vector):
                    groups[vector].add(token)
            if groups:
                want[host] = {frozenset(g) for g in groups.values()}
    got = {}
    for r in ht.classes(ht.tokenised(pages), min_pages=4).collect():
        groups = defaultdict(set)
        for t in r.tokens:
            groups[t["class"]].add(t["token"])
            assert t["size"] == sum(x["class"] == t["class"] for x in r.tokens)
        got[r.host] = {frozenset(g) for g in groups.values()}
    assert got == want and len(want) > 10


def test_order_and_nesting():
    sizes = {1: ("a", 2), 2: ("a", 2), 3: ("b", 2), 4: ("b", 2), 5: ("c", 1)}
    order, parent, bad = ht.instances([1, 5, 3, 4, 9, 3, 4, 2], sizes)
    assert order == {"a": (1, 2), "b": (3, 4), "c": (5,)} and not bad and parent == {"a": None, "b": "a", "c": "a"}
    assert ht.instances([1, 3, 2, 4], sizes)[2] == {"b"}  # b straddles the end of a
    assert ht.instances([1, 1, 2, 2], sizes)[2] == {"a"}
    assert ht.instances([3, 4, 4, 3], sizes)[2] == {"b"}  # two orders
    assert ht.instances([1], sizes)[2] == {"a"}
