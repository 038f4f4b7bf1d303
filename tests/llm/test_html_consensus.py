"""Main text: parsing, furniture, votes, cases."""
from apiatlas.llm.html_consensus import Page, main_text, page_votes
from apiatlas.llm.url_rules import host_and_path
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div><div id="cookie-notice">accept</div>
<article><h1>Head &amp; line</h1><p><b>First&nbsp; part<br>goes on.<br><p>Second   <i>part</i> &lt;x&gt;.</p><ul><li>one<li>two</ul>
<table><tr><td>c1<td>c2</table></article><aside>side</aside><form>your name <input></form><div class="comments"><p>reader says</p></div>
<footer>&copy; foot</footer></body></html>"""
TEXT = "Head & line\nFirst part goes on.\nSecond part <x>.\none\ntwo\nc1\nc2"


def test_article():
    page = Page(PAGE)
    assert page.text(None) == TEXT and [page.paths[k] for k in page.candidates()] == [">html>body>article"]


def test_nothing_of_an_article_is_left_out():
    long = "long text " * 30
    for source in (f"<body><article><h1>head</h1><p>lead</p><div class=body><p>{long}</p></div></article>",
                   f"<body><div><h1>head</h1><div class=body><p>{long}</p></div></div>",
                   f"<body><div class=top><h2>head</h2></div><div class=body><p>{long}</p></div>",
                   f"<body><div class=one><p>{long * 7}</p></div><div class=two><p>{long * 3}</p></div>",
                   f"<body><section><p>{long}</p></section><p>end</p>",
                   f"<body><main><p>before</p><table><tr><td>{long}</table><p>after</p></main>",
                   f"<body><div><p>before</p><table><tr><td>{long}<tr><td>x</table></div>"):
        whole = Page(source)
        assert whole.text(None) == "\n".join(b[0] for b in whole.blocks), source
    two = Page("<div>" + "thousand words " * 500 + "</div><div>Last true line, twelve words of it.</div>")
    assert two.text(None).endswith("\nLast true line, twelve words of it.")


def test_names_are_weak_signs():
    for source, text in (('<div class="content no-sidebar"><p>a</p></div><p>b</p>', "a\nb"), ('<h2 id="related-work">Related work</h2><p class="share-prices">up</p>', "Related work\nup"),
                         ('<form id=aspnet><div><p>whole page</p></div></form>', "whole page"), ('<form><h1>T</h1><p>x</p></form><p>y</p>', "T\nx\ny"),
                         ('<p>x</p><form>your mail <input></form>', "x"), ('<div class="ad-slot-3">buy</div><div>x</div>', "x"),
                         ('<section id="related-work"><p>x</p></section><p>y</p>', "x\ny"), ('<div class="sidebar"><article>x</article></div>', "x"),
                         ('<div class="commentsList"><p>reader</p></div><div>x</div>', "x"), ('<div role="navigation">m</div>x', "x"),
                         ('<div class="ad">only this</div>', "only this"), ('<div><h1>T</h1><div class="ad">buy</div><article><p>x</article></div>', "T\nx"),
                         ('<article>a</article><article>b</article><div>c</div>', "a\nb"), ('<main><article>a</article>b</main>c', "a\nb")):
        assert Page(source).text(None) == text, source


def test_odd_markup():
    for source, text in (("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("a < b <c", "a < b <c"), ('<p title="a>b">t</p>', "t"),
                         ("<div><p>x</div></p></i>y", "x\ny"), ("<article><header><h1>T</h1></header>x<aside>q</aside></article>", "T\nx"),
                         ("<header>h</header><p>x", "x"), ("<p>a<script>if (a<b) {}</script>b<!-- c", "ab"), ("<p>&#233;&eacute;&bad;</p>", "éé&bad;"),
                         ("<pre>a\n\n b</pre>", "a b"), ("<P CLASS=x>u</P><DIV>v", "u\nv"), ("<textarea><p>no</textarea><p>yes", "yes")):
        assert Page(source).text(None) == text, source
    assert Page("<b>" * 20000 + "deep" + "</b>" * 20000).text(None) == "deep"
    assert Page("<div>" * 3000 + "deep").text(None) == "deep"


def brute(pages):
    """Repeated texts by plain counting, then every page by itself."""
    votes = {}
    for host, source in pages:
        page = Page(source)
        for path, key, _ in page.beside():
            votes.setdefault((host, path), {}).setdefault(key, set()).add("\n".join(b[0] for b in page.blocks))
    again = {}
    for (host, _), own in votes.items():
        again.setdefault(host, set()).update(k for k, p in own.items() if len(p) >= 3 and 2 * len(p) > len(set().union(*own.values())))
    return [Page(source).text(None, frozenset(again.get(host, ()))) for host, source in pages]


def test_host_votes(spark):
    """Generated templates: what repeats on a host goes, text of a page's own always stays."""
    box = '<html><body><div class="box{}"><p>{}</p></div><div class="main x{}"><p>{}</p></div></body></html>'
    pages = [("h.net", box.format(i, "the same notice", i, f"text {i} " * 30)) for i in range(6)]
    pages += [("h.net", box.format(6, "own words " * 9, 6, "the real text")), ("other.net", box.format(7, "the same notice", 7, "alone"))]
    pages += [("copies.net", box.format(1, "part one", 2, "part two"))] * 5  # copies are no repetition
    pages += [("div.net", f"<body><div><p>template one {i}</p></div></body>") for i in range(3)]
    pages += [("div.net", "<body><article><p>" + "a whole article " * 20 + "</p></article><div>tiny aside</div></body>"),
              ("div.net", "<body><div>first half</div><div>second half</div></body>")]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", source) for i, (h, source) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert [got[i] for i in range(len(pages))] == brute(pages)
    assert got[0] == ("text 0 " * 30).strip() and got[6] == ("own words " * 9).strip() + "\nthe real text" and got[7] == "the same notice\nalone"
    assert got[8] == "part one\npart two" and got[16] == ("a whole article " * 20).strip() and got[17] == "first half\nsecond half"
    host, _ = host_and_path(F.col("url"))
    assert page_votes(df, "html", host).filter("beside IS NULL").count() == len(pages)


def test_cases(spark):
    rows = [(1, None, None, "k"), (2, "u", "", "k"), (3, "http://a.net/", PAGE, "k"), (3, "http://a.net/", PAGE, "k"), (None, "http://a.net/", "<nav>x</nav>", "k"),
            (4, "http://a.net/", "<p>" + "w " * 100000, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, __path string")
    out = main_text(df)
    assert out.columns == ["page_id", "url", "html", "__path", "text"]
    assert sorted(r["text"] for r in out.collect()) == sorted(["", "", "", TEXT, TEXT, ("w " * 100000).strip()])
    assert main_text(df.limit(0)).count() == 0
