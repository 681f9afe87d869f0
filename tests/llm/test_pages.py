"""HTML extraction: parsing, alignment, templates, and pages of the test tables."""

import itertools
import pathlib
import re
from html import unescape

import pytest

from casewright.llm import html_extract as hx

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("<p>a<p>b &amp; c&nbsp;d", "a\nb & c d"),
    ("x<br>y<div>z <b>w</b></div>", "x y\nz w"),
    ("<!-- a <p>b</p>", ""),
    ("<script>var t='</p>'</script><style>p{}</style><p>k", "k"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<nav>m</nav><div class='sideBar'>s</div><p>t</p><div id=comments><p>c</div><footer>f</footer>", "t"),
    ("<header>h</header><article><header><h1>T</h1></header><p>b<aside>x</aside></article><p>after", "T\nb"),
    ("<main><p>m</main><p>o", "m"),
    ("<head><title>t</title><body><p>q", "q"),
    ("<form><p>name</form><div hidden>h</div><p style='display: none'>i</p>k", "k"),
    ("a < b <p>&lt;tag&gt; <a title='x>y'>l</a>", "a < b\n<tag> l"),
    ("<select><option>a</select>r<textarea><p>z</textarea>", "r"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end", "deep\nend"),
    ("<p>" + "long " * 50_000, ("long " * 50_000).strip()),
])
def test_main_text(page, text):
    assert hx.main_text(page, None) == text


LONG = "many words of the page itself that vary " * 5


@pytest.mark.parametrize("page, text", [
    ("<div class='content has-sidebar'><article><p>t</article></div>", "t"),
    ("<div class='no-sidebar'><h1>h</h1><p>t</div>", "h\nt"),
    ("<article class='post category-social tag-login'><p>t</article><p>o", "t"),
    ("<div class=widget><main><p>t</main></div>", "t"),
    ("<form id=aspnetForm><nav>m</nav><div class=dialog><p>" + LONG + "</div><div class=share>s</div></form>", LONG.strip()),
    ("<article>teaser</article><div><p>" + LONG + "</div>", "teaser\n" + LONG.strip()),
    ("<main><p>" + LONG + "</main><article>teaser</article>", LONG.strip()),
    ("<main><article>teaser</article><p>" + LONG + "</main>", "teaser\n" + LONG.strip()),
    ("<main><p>by</p><article>" + LONG + "</article></main>", LONG.strip()),
    ("<article>" + LONG + "</article><div id=comments><article>c one</article></div>", LONG.strip()),
    ("<p>" + LONG + "</p><div class='nav-menu'>m</div><div class=comments><article>c</article></div>", LONG.strip()),
])
def test_names_do_not_outweigh_the_text(page, text):
    assert hx.main_text(page, None) == text
    # So it is where the wrapper shows what varies.
    host = hx.Host.of_page(page.replace(LONG, "0"))
    for i in range(1, 7):
        host.add(hx.Host.of_page(re.sub(r">(\w[^<]*)", rf">\1 {i}", page)))
    assert hx.main_text(page, host) == text


@pytest.mark.parametrize("page, text", [
    ("<div id=page><article>" + "<div>" * 310 + "</div>" * 310 + "<p>text</p></article></div>", "text"),
    ("<div>" * 400 + "<article><p>t<p>u</article>", "t\nu"),
    ("<p>t</p>" + "<div>" * 400 + "<aside>x<p>y</aside><nav>z</nav>", "t"),
    ("<head><title>t</title><meta name=a><p>q", "q"),
    ("<head><link rel=x><script>s</script>words<p>q", "words\nq"),
    ("<div>" * 100_000 + "<li>a<li>b" + "</section>" * 100_000 + "</div>" * 100_000 + "<p>end", "a\nb\nend"),
])
def test_deep_pages_and_open_heads(page, text):
    assert hx.main_text(page, None) == text
    hosts = [hx.Host.loads(hx.Host.of_page(page + f"<p>{i}").dumps()) for i in range(6)]
    for other in hosts[1:]:
        hosts[0].add(other)
    assert hosts[0].wrapper.seen is hx.ENOUGH
    assert hx.main_text("<ul><li>other</ul>" + page, hosts[0]).startswith("other" if "<article" not in page else "")


def test_deep_templates():
    pages = ["<div>" * 2000 + f"<p>Our site</p><h1>Title {i}</h1>" + "<ul></ul>" * (i % 2) for i in range(6)]
    host = hx.Host.of_page(pages[0])
    for page in pages[1:]:
        host.add(hx.Host.of_page(page))
    host = hx.Host.loads(host.dumps())
    assert [hx.main_text(page, host) for page in pages] == [f"Title {i}" for i in range(6)]


def tree(x):
    """Wrapper from nested tuples (label, *children)."""
    return hx.Wrapper(x[0], 1, set(), [tree(k) for k in x[1:]])


def best_matching(a, b):
    """Simple tree matching by trying all order-preserving child pairs."""
    if a.label != b.label:
        return 0
    best = 0
    for n in range(min(len(a.kids), len(b.kids)) + 1):
        for i in itertools.combinations(a.kids, n):
            for j in itertools.combinations(b.kids, n):
                best = max(best, sum(best_matching(x, y) for x, y in zip(i, j)))
    return 1 + best


def test_alignment_against_all_choices(rng):
    def grow(depth):
        return (str(rng.choice(list("ab"))), *(grow(depth - 1) for _ in range(int(rng.integers(0, 4)) if depth else 0)))

    for _ in range(150):
        a, b = tree(("r", *(grow(1) for _ in range(3)))), tree(("r", *(grow(1) for _ in range(3))))
        got, pairs = hx.aligned(a, b)
        want = best_matching(a, b)
        if a.shape != b.shape:
            assert got == want
        assert pairs == sorted(pairs) and all(a.kids[i].label == b.kids[j].label for i, j in pairs)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'h' AS host", "1 AS wrapper")


def test_texts_on_every_page_are_template(spark):
    page = "<body><div class=x1><p>Our site</p></div><div class=x2><h1>{0}</h1><p>{0} body</p></div><div class=x1>Call us</div>"
    rows = [(i, "http://h/%d" % i, page.format(f"Title {i}")) for i in range(8)]
    rows += [(20, "http://g/1", page.format("Lone")), (21, None, None), (22, "http://e/", "")]
    rows += [(30 + i, "http://same/", page.format("Copy")) for i in range(9)]
    got = {r.page_id: r.text for r in hx.extract_text(pages_of(spark, rows)).collect()}
    assert all(got[i] == f"Title {i}\nTitle {i} body" for i in range(8))
    assert got[20] == "Our site\nLone\nLone body\nCall us" and got[21] == got[22] == ""
    # One page many times over is no evidence of a template.
    assert all(got[30 + i] == "Our site\nCopy\nCopy body\nCall us" for i in range(9))
    assert hx.extract_text(pages_of(spark, [])).collect() == []


def test_copies_are_one_page_in_every_slot(spark):
    page = "<body><p>Our site</p><article><h1>{0}</h1><p>{0} body</p>{1}</article></body>"
    rows = [(i, "http://h/%d" % i, page.format(f"Title {i}", "")) for i in range(5)]
    rows += [(20 + i, "http://h/copy", page.format("Copy", "<ul><li>only here</ul>")) for i in range(6)]
    got = {r.page_id: r.text for r in hx.extract_text(pages_of(spark, rows).coalesce(1)).collect()}
    assert all(got[20 + i] == "Copy\nCopy body\nonly here" for i in range(6))
    assert all(got[i] == f"Title {i}\nTitle {i} body" for i in range(5))
    # Copies that meet in one merged wrapper count once too, and so do they after a round trip.
    host = hx.Host.of_page(rows[0][2])
    for r in rows[1:]:
        host.add(hx.Host.loads(hx.Host.of_page(r[2]).dumps()))
    host = hx.Host.loads(host.dumps())
    assert hx.main_text(rows[5][2], host) == "Copy\nCopy body\nonly here"


@pytest.mark.parametrize("copies", [5, 50])
@pytest.mark.parametrize("others", [0, 20])
def test_pages_stored_again_with_another_stamp_keep_their_article(spark, copies, others):
    page = "<body><div><p>Our site</p></div><div><h1>{0}</h1><p>" + LONG + "{0}</p>{1}</div><div>{2}</div></body>"
    extra = "<blockquote>words said by somebody</blockquote><ul><li>one thing<li>another thing</ul>"
    rows = [(i, "http://h/%d" % i, page.format(f"Title {i}", "", "")) for i in range(others)]
    rows += [(100 + i, "http://h/again", page.format("Again", extra, f"session {i}")) for i in range(copies)]
    got = {r.page_id: r.text for r in hx.extract_text(pages_of(spark, rows).repartition(3)).collect()}
    whole = f"Again\n{LONG}Again\nwords said by somebody\none thing\nanother thing"
    site = "" if others else "Our site\n"
    assert all(got[100 + i] == f"{site}{whole}\nsession {i}" for i in range(copies))
    assert all(got[i] == f"Title {i}\n{LONG}Title {i}" for i in range(others))


@pytest.mark.parametrize("page, text", [
    ("<article><p>Let <math><mi>x</mi></math> be real.</article>", "Let x be real."),
    ("<p>see <object data=a.svg>the figure</object> here", "see the figure here"),
    ('<p>a<a href="x>link tail', "alink tail"),
    ("<p>k<b class='>l</b>m", "klm"),
    ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
])
def test_formulas_objects_and_open_quotes(page, text):
    assert hx.main_text(page, None) == text


def test_pages_table(spark):
    if not pathlib.Path(SF).exists():
        pytest.skip("no test tables here")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in hx.extract_text(pages).collect():
        article = re.search(r"<article>(.*)</article>", html[r.page_id], re.DOTALL)[1]
        blocks = [unescape(re.sub("<[^>]*>", " ", b)) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(" ".join(b.split()) for b in blocks if b.strip())
