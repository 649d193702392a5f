"""Wrapper induction: tree matching, hand pages, the test pages' articles."""

import html
import random
import re

from lectern.llm import wrapper
from lectern.llm.wrapper import main_text


def test_simple_tree_matching():
    a = wrapper.parse("<div><ul><li>a<li>b</ul><p>x</p></div>")
    b = wrapper.parse("<div><ul><li>c</ul><p>x</p><p>y</p></div>")
    pairs = []
    assert wrapper.simple_tree_matching(a, b, pairs) == len(pairs) == 5
    assert wrapper.simple_tree_matching(a, a) == 6


PAGE = "<html><body><div class=top>Site name</div><div class=menu><a href=/>Home</a></div><div><div><h1>{t}</h1><p>{t} one &amp; two&nbsp;three</p><p>more<br>of {t}</p></div><div>All rights kept</div></div><script>var x='<p>no</p>'</script><div id=comments><p>I agree</p></div></body></html>"


def test_wrapper_without_article():
    pages = [PAGE.format(t=t) for t in ("alpha beta", "gamma", "delta eps")]
    constant, slot = wrapper.induce(pages)
    assert slot == "/html/body/div/div"
    assert wrapper.main_text(pages[1], frozenset(constant), slot) == "gamma gamma one & two three more of gamma"


def test_article_wins_and_boilerplate_goes():
    page = "<nav>menu</nav><article><header>by me</header><h1>T</h1><p><b>bold</b>face<p>next <aside>ad</aside><form>f</form><div class='ad box'>buy</div><div class=comments>c</div><ul><li>i<li>j</ul></article><footer>f</footer>"
    assert wrapper.main_text(page) == "T boldface next i j"


def test_template_goes_from_articles(spark):
    page = "<body><article><h1>{t}</h1>Read our daily letter<div><p>{t} starts</p><p>Sign here</p></div><p>{t} ends</p></article></body>"
    rows = [(i, f"http://a.b/{i}", page.format(t=t)) for i, t in enumerate(("alpha", "beta", "gamma", "delta"))]
    copies = [(i, f"http://c.d/{i}", page.format(t="same")) for i in range(10, 19)]  # copies are no evidence of a template
    pair = [(20, "http://e.f/1", page.format(t="pair")), (21, "http://e.f/2", page.format(t="pair").replace("ends", "stops"))]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows + copies + pair, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"{t} {t} starts {t} ends" for t in ("alpha", "beta", "gamma", "delta")]
    assert {got[i] for i in range(10, 19)} == {"same Read our daily letter same starts Sign here same ends"}
    assert got[20] == "pair Read our daily letter pair starts Sign here pair ends"


def test_odd_html():
    for page in (None, "", "<", "<p", "<p>a<b", "</div></p>x", "<!-- c", "&#x110000;", "plain"):
        assert isinstance(wrapper.main_text(page), str)
    assert wrapper.main_text("plain &lt;text&gt;") == "plain <text>"


def test_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in wrapper.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        assert got[r.page_id].text == " ".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_odd_rows(spark):
    rows = [(1, "http://a.b/x", "<article><p>t</p></article>", "x"), (1, "http://a.b/x", "<article><p>t</p></article>", "x"), (2, None, "<p>u</p>", "x"), (3, "odd", None, "x"), (None, "http://a.b", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = wrapper.extract(df).collect()
    assert sorted((r.text for r in got)) == ["", "", "t", "t", "u"]
    assert wrapper.extract(df.limit(0)).collect() == []


def _plain_matching(a, b):
    if a.sign != b.sign:
        return 0
    x, y = a.children, b.children
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            m[i][j] = max(m[i][j - 1], m[i - 1][j], m[i - 1][j - 1] + _plain_matching(x[i - 1], y[j - 1]))
    return m[-1][-1] + 1


def test_matching_against_plain(monkeypatch):
    rng = random.Random(5)

    def grow(deep):
        return wrapper.Node("", rng.choice("ab") if deep < 4 else "r", parts=[grow(deep - 1) for _ in range(rng.randint(0, 5))] if deep else [])

    for cells in (1 << 20, 3):  # in one table, and halved
        monkeypatch.setattr(wrapper, "CELLS", cells)
        for _ in range(60):
            a, b, pairs = grow(4), grow(4), []
            assert wrapper.simple_tree_matching(a, b, pairs) == len(pairs) == _plain_matching(a, b)
            assert all(p.sign == q.sign for p, q in pairs) and len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs}) == len(pairs)


def test_all_slots_whole_trees_and_layouts(spark):
    links = "".join(f"<li><i>{i}</i> link" for i in range(900))
    first = "<body><div class=top>Site</div><div class=list><ul>" + links + "</ul></div><div class=title><h2>{t}</h2></div><div class=one><div><p>{t} one</p></div><p>Kept by us</p></div><div class=two><p>{t} two</p></div></body>"
    second = "<body><section><p>Our shop</p><p>{t} costs</p></section></body>"
    names = ("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta")
    rows = [(i, f"http://a.b/{i}", first.format(t=t)) for i, t in enumerate(names)] + [(10 + i, f"http://a.b/s{i}", second.format(t=t)) for i, t in enumerate(names[:2])]
    alone = (20, "http://c.d/", "<body><div><h2>head</h2></div><div><p>a long body of text</p><p>more of it</p></div></body>")
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame([*rows, alone], "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [f"{t} {t} one {t} two" for t in names]
    assert [got[10], got[11]] == ["alpha costs", "beta costs"]
    assert got[20] == "head a long body of text more of it"


def test_deep_nesting_keeps_text():
    n = 20_000
    page = "<div>" * n + "<p>deep <b>text</b></p><nav>menu</nav>" + "</div>" * n + "<p>after</p>"
    assert wrapper.main_text(page) == "deep text after"
    assert wrapper.main_text("<div><i class=ad>" * 3000 + "x") is not None
    other = page.replace("deep", "low")
    constant, slot = wrapper.induce([page, other])
    assert wrapper.main_text(page, frozenset(constant), slot) == "deep text"


def test_names_are_weak_hints():
    body = "<p>" + "word " * 40 + "</p>"
    want = " ".join(["word"] * 40)
    assert wrapper.main_text(f'<article class="review"><h2 id="related">Head</h2>{body}</article>') == "Head " + want
    assert wrapper.main_text(f'<div class="post social">{body}</div><div class="share">tell all</div>') == want
    assert wrapper.main_text(f'<article>{body}<section class="legal analysis"><p>law</p></section><div class="comments">{body}{body}</div></article>') == want + " law"
    assert wrapper.main_text(f'<article>{body}</article><article class="teaser"><p>next story</p></article>') == want


def test_the_wrapper_decides(spark):
    rows = [(i, f"http://a.b/{i}", f"<body><div><div>Buy our paper</div><h1>{t} head</h1><p>{t} body</p><div>Call us today</div></div></body>") for i, t in enumerate(("alpha", "beta", "gamma"))]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [f"{t} head {t} body" for t in ("alpha", "beta", "gamma")]
    assert wrapper.main_text(rows[0][2]) == "Buy our paper alpha head alpha body Call us today"  # as it would be without


BODY = "The river rose over night and the town woke to water in its streets, said the mayor. " * 4


def test_forms():
    page = "<html><body><form action=x><input type=hidden name=v value=1>{}<input type=submit></form></body></html>"
    assert main_text(page.format(f"<article><p>{BODY}</p></article>")) == BODY.strip()
    assert main_text(page.format(f"<div><p>{BODY}</p></div>")) == BODY.strip()
    assert main_text(f"<body><article><p>{BODY}</p><form><label>Your mail</label><input name=a><input type=submit></form></article></body>") == BODY.strip()


def test_hints_do_not_empty_an_article():
    for name in ("social", "reviews", "comments"):
        assert main_text(f'<body><article><h1>Book</h1><section class="{name}"><p>{BODY}</p></section></article><div>{BODY * 3}</div></body>') == f"Book {BODY.strip()}"
    with_text = f'<body><article><h1>Book</h1><p>{BODY}</p><section class="comments"><p>{BODY * 3}</p></section><div class="ad">Buy now</div></article></body>'
    assert main_text(with_text) == f"Book {BODY.strip()}"


def test_a_counter_does_not_widen_the_slot():
    pages = [f'<html><body><div class="top">Site</div><div class="count">{n * 37} visitors</div><div class="body"><h1>Title {w}</h1><p>{w} {BODY} {w}</p></div></body></html>' for n, w in enumerate(["ash", "birch", "cedar", "dogwood", "elm"])]
    constant, slot = wrapper.induce(pages)
    assert slot.endswith("div.body")
    assert main_text(pages[2], frozenset(constant), slot) == f"Title cedar cedar {BODY}cedar"
    assert "visitors" in main_text(pages[2])  # without the wrapper


def test_hostile_pages_take_time_in_proportion():
    import time

    for piece in ("<!--", "<script>", "<style ", "<!", "<div ", "<a href='", "</", "<?x "):
        html = f"<body><article>{BODY}" + piece * (5_000_000 // len(piece))
        began = time.process_time()
        wrapper.layout(html)
        assert time.process_time() - began < 3, piece
        if piece in ("<!--", "<script>", "<style "):
            assert main_text(html) == BODY.strip()
        assert time.process_time() - began < 6, piece


def test_scrub():
    assert wrapper.scrub("a<!-- x -->b<SCRIPT>if (a<b) '<!--'</Script >c<!-->d<style>s</style>e<!--f") == "abcde"
    assert wrapper.scrub(None) == "" and wrapper.scrub("x < y <b") == "x < y " and wrapper.scrub("a < 3") == "a < 3"


def test_counts_come_from_all_pages(spark):
    """The content slot follows all pages of a layout, not some of them: a text that varies on one page of forty widens it."""
    page = lambda i, notice, lead: f"<html><body><div class='top'><p>Lead {lead}</p><section><p>{notice}</p><p>body {chr(97 + i // 26)}{chr(97 + i % 26)}</p></section></div></body></html>"
    for seed in range(3):
        rows = [(i, f"http://h{k}.org/{i}", page(i, "Sign up now" if i % 40 < 26 else f"own {chr(97 + i % 26)}", "rare" if i == seed else "same")) for k in range(2) for i in range(40)]
        got = {(r.page_id, r.url.split(".")[0]): r.text for r in wrapper.extract(spark.createDataFrame([*rows, *rows[:9]], "page_id long, url string, html string").repartition(5)).collect()}
        assert {x[0] for x in got if "Lead rare" in got[x]} == {seed}, got  # the slot holds what varies anywhere


def test_wrapper_of_counts(spark):
    """Counts of parts of the pages, added up, give the wrapper of all pages."""
    pages = [f"<div><p>Same</p><b>n</b><section><p>views {i}</p><p>{'abcdefgh'[i] * 3}</p></section></div>" for i in range(8)]
    first = wrapper.Reference(pages[0])
    shown = [first.compare(p) for p in pages[1:]]
    counts = {}
    for hits, _ in shown:
        for h in hits:
            counts[h] = counts.get(h, 0) + 1
    paths = [v for _, v in shown if v]
    assert first.wrapper(counts, 7, wrapper._within(min(paths), max(paths))) == wrapper.induce(pages)
    assert wrapper.main_text(pages[3], frozenset(wrapper.induce(pages)[0]), wrapper.induce(pages)[1]) == "views 3 ddd"
