import json
import re

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import wrappers
from tessella.llm.wrappers import BLOCKS, PARTS, Article, _matches, expression, extract, main_text, merge, op2_wrapper_extraction, wrapper_of

PAGES = [
    ('<body class="with-sidebar"><main><header><h1 class="entry-header">T</h1></header><p>a<script>var x="</p>";</script>b<p hidden>zz</p><p>c &amp;lt; &nbsp; d</main><div id=comments><article><p>no</p></article></div>', "T\nab\nc &lt; d"),
    ("<p>just text", "just text"),
    ("text only & more", "text only & more"),
    ('<a href="x>y">l</a> <p title="a>b">q</p>', "l\nq"),
    (None, ""),
    ("", ""),
    ("<nav>menu</nav>", ""),
    ("<div><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></div><section class='newsletter'><p>z</section>", "one\ntwo\nx\ny"),
    ("<", "<"),
    ("<article><h1>A</h1><p>one<br>two <b>th</b>ree</p><aside>x</aside><form><input><p>f</p></form><div class='cookie-notice'>c</div><p>end", "A\none two three\nend"),
    ("<header>Site</header><div class='ad'>buy</div><article><p>x</p><!-- <p>gone</p> --><section class=comments><p>nice</p></section></article><footer>f</footer>", "x"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_single_pages(html, text):
    assert main_text(html, None) == text


def _host(pages):
    found = None
    for p in pages:
        found = merge(found, wrapper_of(p)[0])
    return found


def _of_host(pages):
    article = Article(_host(pages))
    return [main_text(p, article) for p in pages]


def _page(title, *ps, end="All rights reserved"):
    return f"<div class=top><b>My Site</b></div><div><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in ps)}</div><div>{end}</div>"


def test_wrapper_of_a_host_without_article_elements():
    pages = [_page("One", "a b", "c"), _page("Two", "d"), _page("Three", "e", "f", "g")]
    assert expression(_host(pages)) == 'div ( "My Site" ) div ( h1 ( # ) ( p ( # ) )+ ) div ( "All rights reserved" )'
    assert _of_host(pages) == ["One\na b\nc", "Two\nd", "Three\ne\nf\ng"]


def test_the_wrapper_decides_where_one_page_does_not_tell():
    long = "a long line under the article that changes from page to page"
    pages = [_page(f"T{i}", *["some words of an article, " * 5] * 3, end=f"{long} {i}") for i in range(5)]
    short = _page("Brief", "few", end=f"{long} x")
    article = Article(_host([*pages, short]))
    assert main_text(short, article) == "Brief\nfew"
    assert main_text(short, None) != "Brief\nfew"


def test_constant_texts_of_an_article_stay():
    pages = [_page("Introduction", "see below", "x" * i) for i in range(1, 6)]
    assert _of_host(pages) == [f"Introduction\nsee below\n{'x' * i}" for i in range(1, 6)]


def test_constant_texts_around_a_flat_page_go():
    pages = [f"<div>My Site</div><h1>Same</h1><p>{'word ' * i}<p>middle<p>end {i}<div>Imprint</div>" for i in range(1, 5)]
    assert _of_host(pages)[1] == "Same\nword word\nmiddle\nend 2"


def test_a_word_of_a_class_is_overruled_by_slots_of_many_pages():
    page = lambda i: f"<div>Site</div><div class='widget-body'><h1>Title {i}</h1>{f'<p>words of page {i}</p>' * 8}</div>"
    pages = [page(i) for i in range(5)]
    assert _of_host(pages)[2].startswith("Title 2\nwords of page 2")
    assert main_text(pages[2], None) == "Site"


def test_title_before_the_article():
    pages = [f"<div><h1>Title {i}</h1></div><div>{f'<p>some words {i}</p>' * 9}</div><div>end</div>" for i in range(3)]
    assert _of_host(pages)[1].split("\n")[:2] == ["Title 1", "some words 1"]


def test_pages_of_another_form_are_their_own():
    pages = [f"<article><p>text {i}</p></article>" for i in range(4)] + ["<div><div><main><h2>Other</h2><p>form</p></main></div></div>"]
    assert _of_host(pages)[-1] == "Other\nform"


def test_optional_parts():
    assert expression(_host(["<h1>x</h1><p>y", "<h1>z</h1><h2>s</h2><p>y"])) == 'h1 ( # ) ( h2 ( "s" ) )? p ( "y" )'


def test_repetitions():
    assert expression(wrapper_of("<h1>t</h1><h2>a</h2><p>b<ul><li>1<li>2</ul><h2>c</h2><p>d<ul><li>3</ul>")[0]) == 'h1 ( "t" ) ( ( h2 ( # ) )* ( p ( # ) )* ( ul ( ( li ( # ) )+ ) )* )+'
    assert expression(wrapper_of("<div>x</div>" * 7)[0]) == '( div ( "x" ) )+'


def test_equal_pages_keep_their_text():
    assert _of_host(["<div><h1>T</h1><p>x</p></div>"] * 2) == ["T\nx"] * 2


def test_order_of_merging_and_transport():
    pages = [_page(f"T{i}", *["p"] * (i % 4), end=f"e{i}") + ("<section><h2>s</h2></section>" if i % 3 else "") for i in range(12)]
    one = Article(json.loads(json.dumps(_host(pages))))
    parts = Article(merge(_host(pages[6:]), _host(pages[:6])))
    assert [main_text(p, one) for p in pages] == [main_text(p, parts) for p in pages]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["h1", "p", "ul", "div", "section", "nav-"]), max_size=6), st.lists(st.sampled_from(["h1", "p", "ul", "div", "section", "nav-"]), max_size=6))
def test_alignment_is_the_best(a, b):
    p, q = ([[x, 1, False, None, 0, 0, [], None] for x in labels] for labels in (a, b))

    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return max(best(i + 1, j), best(i, j + 1), (1 + best(i + 1, j + 1)) if a[i] == b[j] else 0)

    pairs = _matches(p, q)
    assert len(pairs) == best(0, 0) and all(a[i] == b[j] for i, j in pairs)
    assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<h1>a", "<p>b", "<div>c</div>", "<div><p>d</div>", "<section><h2>e</h2></section>", "text", "<ul><li>x</ul>", "</div>", "<article>f"]), max_size=8), min_size=1, max_size=5))
def test_no_text_is_lost_or_doubled(pages):
    """Every page's blocks stand once each in what is taken and what isn't, whatever was folded."""
    pages = ["".join(p) for p in pages]
    article = Article(_host(pages))
    for p in pages:
        own, blocks = wrapper_of(p)
        every = []

        def walk(node, every=every):
            every.extend(node[BLOCKS] or [])
            for x in node[PARTS]:
                walk(x)

        walk(own["root"])
        assert sorted(every) == list(range(len(blocks)))
        found = article.blocks(own["root"])
        assert len(set(found)) == len(found)
        assert "\n" in main_text(p, article) or main_text(p, article) in blocks or not blocks or main_text(p, article) == ""


def test_articles_of_whole_hosts_without_names():
    """Names taken away, slots and repetitions alone find the articles of the given pages."""
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    hosts = {}
    for r in rows:
        hosts.setdefault(r["url"].split("/")[2], []).append(r["html"])
    right = total = 0
    for pages in hosts.values():
        bare = [re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", p)) for p in pages]
        for got, page in zip(_of_host(bare), pages, strict=True):
            want = main_text(page, None).split("\n")
            right += len(set(want) & set(got.split("\n")))
            total += len(set(want))
    assert right >= 0.99 * total


def test_deep_and_long_pages():
    n = 20_000
    assert main_text("<div>" * n + "<p>x" + "</div>" * n, None) == "x"
    assert main_text("<div>a<section>" * n, None).count("\n") == n - 1
    assert len(main_text("<article>" + "<p>word" * n, None).split("\n")) == n


@pytest.mark.parametrize("depth", [0, 20, 120, 500, 1500])
def test_depth_doesn_t_change_the_text(depth):
    """Within any number of elements, alone and by its host's wrapper, which is written and read in between."""
    page = lambda k: "<body>" + "<div>" * depth + f"<div class=bar>Site bar words</div><div><h1>Title {k}</h1>" + "".join(f"<p>Sentence {j} of the text {k}, with some words of its own.</p>" for j in range(6)) + "</div><div class=related>related junk</div>" + "</div>" * depth
    want = lambda k: "\n".join([f"Title {k}", *[f"Sentence {j} of the text {k}, with some words of its own." for j in range(6)]])
    assert _of_host([page(k) for k in range(4)]) == [want(k) for k in range(4)]


def _unlike(rnd, n, kinds=12):
    tags = "p span ul ol dl table pre blockquote h2 h3 figure address b i em".split()
    return [f"<div class=c{rnd.randrange(4)}>" + "".join(f"<{t}>{rnd.randrange(99)}</{t}>" for t in rnd.sample(tags, rnd.randrange(1, kinds))) + "</div>" + rnd.choice(["", "", "<p>x", "<hr>"]) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_alignment_by_rows_equals_that_by_pairs(seed, monkeypatch):
    import random

    rnd = random.Random(seed)
    sides = [wrappers.stream("<body>" + "".join(_unlike(rnd, rnd.randrange(1, 60))))[0][wrappers.PARTS][0][wrappers.PARTS] for _ in range(2)]
    for side in sides:
        if rnd.random() < 0.7:
            side[:] = wrappers.folded([wrappers._fold(x) if x[wrappers.LABEL] != "#" else x for x in side])
    found = []
    for few in (10**9, -1):
        monkeypatch.setattr(wrappers, "FEW_PAIRS", few)
        found.append(wrappers._matches(*sides))
    assert found[0] == found[1]


def test_many_unlike_siblings(monkeypatch):
    """10,000 on each side: seconds, and memory for rows of pairs, not for all pairs."""
    import random
    import time
    import tracemalloc

    rnd = random.Random(1)
    sides = []
    for k in (0, 1):
        nodes = []
        for j in range(10_000):
            node = wrappers._node("div")
            node[wrappers.PARTS] = [wrappers._node(f"x{rnd.randrange(300)}") for _ in range(6)]
            nodes.append(node)
        sides.append(nodes)
    sides[1][::7] = sides[0][::7]
    tracemalloc.start()
    began = time.perf_counter()
    pairs = wrappers._matches(*sides)
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) >= 1428 and pairs == sorted(pairs) and took < 90 and peak < 300e6


def test_other_columns_stay(spark):
    rows = [(1, "h", "w", "t", "https://a.example/1", "<p>x", [1], None)]
    df = spark.createDataFrame(rows, "page_id long, host string, wrapper string, text string, url string, html string, label array<int>, salt string")
    out = extract(df).collect()[0]
    assert (out.host, out.wrapper, out.text, out.label, out.url) == ("h", "w", "x", [1], "https://a.example/1")


def test_query(spark, tmp_path, empty_dir):
    rows = [(i, f"https://H.example:80/{i}" if i % 2 else None, html) for i, (html, _) in enumerate(PAGES)]
    rows.append(rows[1])
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = op2_wrapper_extraction(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    want = {i: text for i, (_, text) in enumerate(PAGES)}
    for r in out:
        if "article" in (PAGES[r.page_id][0] or "") or not want[r.page_id]:
            assert r.text == want[r.page_id]
        assert r.n_chars == len(r.text)
    assert op2_wrapper_extraction(spark, empty_dir).collect() == []


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>T</title><meta charset=utf-8><body><article><p>x</article>", "x"),
        ("<head><title>T</title><article><p>x</p></article>", "x"),
        ("<head><title>T</title>only text", "only text"),
        ("<head><title>T</title></head><form id=f><nav>m</nav><article><p>x</p><aside>no</aside></article></form>", "x"),
        ("<div class=login-page><main><p>x</p></main></div>", "x"),
        ("<div hidden><main><p>x</p></main></div>", ""),
        ("<main><p>x</p><div class=related><article><p>no</p></article></div></main>", "x"),
        ("<article><p>a<p class=notice>no<p>b<p>c</p></article>", "a\nb\nc"),
        ("<article><p class=notice>no<div>b</div><p>c</article>", "b\nc"),
        ("<article><ul><li class=share>no<li>b<li>c</ul><dl><dt class=ad>no<dd>d</dl></article>", "b\nc\nd"),
        ("<article><ul><li class=share>no<ul><li>no</ul><p>no<li>b</ul></article>", "b"),
    ],
)
def test_omitted_end_tags_and_wrapping_forms(html, text):
    assert main_text(html, None) == text
