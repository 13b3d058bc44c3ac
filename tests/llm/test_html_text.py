import html
import random
import re
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandlens.llm import html_text


def slow(page):
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", m.group(1).replace("<br>", " "))) if m else []
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: slow(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


MESSY = """<!DOCTYPE html><HTML><head><title>No</title><style>p{}</style></head><body class="page"><header><h2>Site</h2></header>
<div id="cookie-notice">We use cookies</div><nav><ul><li><a href="/">Home</a></ul></nav><aside class="sidebar">Side</aside>
<main><article data-x="a>b"><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>&nbsp;text<br>next<p>Two <script>if (a<b) x("</p>")</script>end
<ul><li>first<li>second <i>item</i></ul><form><input value="x"><p>Send</form><!-- gone > --><div class="comments"><p>Nice!</p></div>
<table><tr><td>c1<td>c2</table><blockquote>Quote</blockquote></article></main><footer>&copy; Foot</footer>"""


def test_messy_page(spark):
    pages = spark.createDataFrame([(1, "http://h.example/1", MESSY, "t"), (2, None, None, "t"), (3, "http://h.example/2", "", "t"), (3, "http://h.example/2", "", "t"), (None, "x", "<p>a<p>b", "t"), (4, "", "just < text & more", "t")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 6
    assert got[1] == "Title & more\nOne bold text next\nTwo end\nfirst\nsecond item\nc1\nc2\nQuote"
    assert got[2] == got[3] == "" and got[None] == "a\nb" and got[4] == "just < text & more"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_template_of_pages_without_marks(spark):
    """Pages of plain divs: what is the same on all pages of the host is template, the slots that vary are content."""
    page = "<html><body><div class=x>Daily Example</div><div class=y><div>{0} head</div><div>{0} body text</div><div>All rights reserved</div></div></body></html>"
    pages = spark.createDataFrame([(i, f"https://u:p@News.Example:80/{i}", page.format(f"Story {i}")) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {i: f"Story {i} head\nStory {i} body text" for i in range(12)}


def test_templates_decide(spark):
    """Pages without telling tags or names: with templates switched off the result is another one."""
    page = "<body><div><div>Daily Example</div><div>Login or join</div></div><div><div>{0} head</div><div>{0} text</div><div>Ask {0}</div></div><div>All rights</div></body>"
    pages = spark.createDataFrame([(i, "https://h.example/", page.format(f"Story {i}")) for i in range(12)], "page_id long, url string, html string")
    with_templates, without = ({r.page_id: r.text for r in html_text.extract(pages, constant=c).collect()} for c in (html_text.CONSTANT, 2.0))
    assert with_templates == {i: f"Story {i} head\nStory {i} text\nAsk Story {i}" for i in range(12)}
    assert all(t.startswith("Daily Example\nLogin or join\n") and t.endswith("All rights") for t in without.values())


def test_one_odd_page_does_not_take_the_template_away(spark):
    page = "<body><div><div>Daily Example</div><div>{0}</div></div></body>"
    rows = [(i, "https://h.example/", page.format(f"Story {i}")) for i in range(9)] + [(100 + i, "https://h.example/", f"<p>error {i}</p>") for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}" for i in range(9)} | {100 + i: f"error {i}" for i in range(4)}


def test_near_copies_keep_their_prose(spark):
    page = "<article><h1>One</h1><p>The long text that all of them have.</p><p>{0}</p></article>"
    rows = [(i, "https://h.example/", page.format(i)) for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"One\nThe long text that all of them have.\n{i}" for i in range(20)}


def test_misleading_tags_and_names(spark):
    pages = {
        1: "<main><p>Intro text</p><article><p>teaser</p></article><p>The main body</p></main>",
        2: "<article class='post related-work'><p>All of it</p></article>",
        3: "<div class='share-price-report'><p>Prices rose</p></div><div class='share-buttons'>Share</div>",
        4: "<main><article><p>The story</p></article><div class=comments><article class=comment><p>Nice</p></article></div></main>",
        5: "<div class='related'><article><p>teaser</p></article></div><div><p>A much longer text than that of the teaser, which is the page's own</p></div>",
        6: "<div class='comments'><p>only comments</p></div>",
        7: "<main><div class='subscription-model'><p>On models</p></div></main>",
    }
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(i, f"http://h{i}/", p) for i, p in pages.items()], "page_id long, url string, html string")).collect()}
    assert got == {1: "Intro text\nteaser\nThe main body", 2: "All of it", 3: "Prices rose", 4: "The story", 5: "A much longer text than that of the teaser, which is the page's own", 6: "only comments", 7: "On models"}


def test_a_name_never_takes_the_article_away(spark):
    long = "A much longer text than anything else on the page, which is what the page is about."
    names = ["alert-story", "notice-text", "social-stories", "related-topics", "ad-content", "share-page", "comments-page", "widget"]
    rows = [(i, f"http://h{i}/", f"<div class='story'><p>Short line.</p></div><div class='{n}'><p>{long}</p></div>") for i, n in enumerate(names)]
    # beside an article or more text the same names do mark
    rows += [(100 + i, f"http://g{i}/", f"<div class='story'><p>{long}</p></div><div class='{n}'><p>Short line.</p></div>") for i, n in enumerate(names)]
    rows += [(200, "http://e/", f"<article><p>{long}</p></article><div class='comments'><p>{long * 5}</p></div>"), (201, "http://f/", f"<main><div class='ad-content'><p>{long}</p></div></main>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Short line.\n{long}" for i in range(len(names))} | {100 + i: long for i in range(len(names))} | {200: long, 201: long}


def test_hosts_of_few_pages_lose_their_short_template(spark):
    """Three pages of plain divs: short texts that all have are template, long ones need more pages."""
    same = "A text that all three pages have, but so long that three pages do not make it the template of their host, as it may be what they quote."
    page = "<body><div><div>Daily Example</div><div>Home</div></div><div><div>{0} text</div><p>Quoted</p><div>" + same + "</div></div><div>All rights reserved</div></body>"
    rows = [(i, "https://h.example/", page.format(f"Story {i}")) for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} text\nQuoted\n{same}" for i in range(3)}


def test_templates_take_a_frame_off_the_given_pages(spark):
    """The given pages without their tags, classes and ids, each in a frame of its host: templates alone take the frame away, and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where(F.col("html").contains("<body>")).withColumn("host", html_text.host(F.col("url")))
    for tag in ("article", "nav", "footer", "header", "aside", "main"):
        pages = pages.withColumn("html", F.regexp_replace("html", f"(?i)<(/?){tag}\\b[^>]*>", "<$1div>"))
    pages = pages.withColumn("html", F.regexp_replace("html", "(?i) (class|id|role)=(\"[^\"]*\"|'[^']*'|[^ >]+)", ""))
    frame = F.concat(F.lit("<body><div><div>Daily "), "host", F.lit("</div><div>Home</div><div>About us</div></div><div>All rights reserved</div>"))
    framed = pages.withColumn("html", F.replace("html", F.lit("<body>"), frame))
    plain = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    on, off = ({r.page_id: r.text for r in html_text.extract(framed, constant=c).collect()} for c in (html_text.CONSTANT, 2.0))
    several = [r.page_id for r in pages.select("page_id", F.count("*").over(Window.partitionBy("host")).alias("n")).where("n > 2").collect()]
    assert len(several) > 150 and all(t.startswith("Daily ") for t in off.values())
    assert sum(on[i] == plain[i] for i in several) > 0.98 * len(several)


def matched(x, y):
    """Nodes of a largest match, by plain recursion."""
    if x.label != y.label:
        return 0
    rows = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
    for i, a in enumerate(x.children):
        for j, b in enumerate(y.children):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + matched(a, b))
    return 1 + rows[-1][-1]


def test_tree_matching_is_the_largest(monkeypatch):
    rng = random.Random(11)

    def made(depth):
        tag = rng.choice(["div", "section", "ul"])
        return f"<{tag}>{''.join(made(depth - 1) for _ in range(rng.randrange(4))) if depth else rng.choice('ab')}x</{tag}>"

    for _ in range(150):
        a, b = (html_text.parse("".join(made(rng.randrange(4)) for _ in range(rng.randrange(1, 6)))) for _ in "ab")
        shapes = html_text.Shapes()
        shapes.name(b)
        monkeypatch.setattr(html_text, "SMALL", rng.choice([0, 4, 600]))
        matcher = html_text.named(a, shapes)
        matcher.weigh([(a.shape, b.shape)] if a.shape != b.shape and a.children and b.children else [])
        assert matcher.weight(a.shape, b.shape) == matched(a, b)
        pairs = matcher.pairs([c.shape for c in a.children], [c.shape for c in b.children])
        assert 1 + sum(matched(a.children[i], b.children[j]) for i, j in pairs) == matched(a, b)
        assert sorted(pairs) == sorted(pairs, key=lambda p: p[1])


def test_tree_matching():
    a, b = html_text.parse("<div><p>1</p><p>2</p><h2>x</h2><p>3</p></div>"), html_text.parse("<div><p>1</p><h2>y</h2><p>9</p><p>4</p></div>")
    pairs = [(x.text, y.text) for x, y in html_text.align(a, b)]
    assert len(pairs) == 3 and ("x", "y") in pairs and ("3", "9") in pairs or ("3", "4") in pairs


def test_long_lists_and_deep_trees(spark):
    long = [html_text.parse("<article>" + "".join(f"<p>{i}</p>" if i % 7 != k else f"<h3>{i}</h3>" for i in range(20000)) + "</article>") for k in (2, 3)]
    start = time.time()
    assert len(html_text.align(*long)) > 17000 and time.time() - start < 60
    deep = ["<div>" * 5000 + "<p>one</p>" + "</div><p>x</p>" * k for k in (4000, 3000)]
    pages = spark.createDataFrame([(k, "http://h/", p) for k, p in enumerate([*deep, *deep])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[0] == got[2] == "one" + "\nx" * 4000 and got[1] == "one" + "\nx" * 3000


def test_marks():
    assert all(html_text.mark_of(n).startswith("!") for n in ("comments-list", "box ad", "sidebar_left", "ad-300x250", "cookieNotice", "comments story ad"))
    assert all(html_text.mark_of(n) == f"?{n}" for n in ("alert-story", "notice-text", "social-stories", "related-topics", "ad-content", "share-page", "post-comments"))
    assert not any(html_text.mark_of(n) for n in ("has-sidebar content", "header-image address download"))
    assert html_text.mark_of("share-price-report") == "share-price-report" and html_text.mark_of("post related-work", article=True) == ""


def test_pages_of_a_slot_are_counted_exactly(spark):
    # slot k has its text in exactly nine tenths of the pages, slot 10 + k in one page less
    leaf = "struct<text:string,kind:int,prose:boolean,mark:string,slots:array<struct<slot:bigint,same:boolean>>>"
    rows = [("h", [(f"{i} {k}", 0, False, "", [(k, (i + k) % 10 > 0 and (k < 10 or i != k + 1))]) for k in range(20)]) for i in range(4000)]
    found = spark.createDataFrame(rows, f"host string, leaves array<{leaf}>")
    got = html_text.templates(found).collect()
    assert [sorted(r.template) for r in got] == [list(range(10))]
