import html as html_module
import random

import pytest

from cohortal.core.settle import settle
from cohortal.llm import wrappers
from tests.llm.helpers import prose


def text_of(page):
    return " ".join(x.text for x in wrappers.leaves(wrappers.parse(page)) if x.zone != wrappers.DROPPED)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<p>a<p>b<br>c<b>d</b>e", "a b cde"),
        ("<nav>x</nav><script>var a='<p>';</script><!-- c --><p>y</p><style>p{}</style>", "y"),
        ("<div class='ad'>x</div><div class=\"main-content\">y &lt;b&gt;</div>", "y <b>"),
        ("<article><header><h1>T</h1></header><p>A</p><aside>s</aside></article><div id=comments><p>no</p></div>", "T A"),
        ("<p>cut <a href='x", "cut"),
        ("<ul><li>one<li>two</ul></div></p>", "one two"),
        ("<p hidden>x</p><p style='display:none'>y</p><p>z&nbsp;&#233;</p>", "z é"),
        ("<form>q<input value=1></form><p>r", "r"),
        ("a < b <p>c", "a < b c"),
    ],
)
def test_parser(page, text):
    assert text_of(page) == text


def brute_match(one, two):
    if one.tag != two.tag:
        return 0
    a, b = one.children, two.children
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + brute_match(x, y))
    return 1 + best[-1][-1]


def test_tree_match_is_the_plain_recursion():
    rng = random.Random(5)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{rng.randrange(9)}</p>"
        return f"<{(t := rng.choice(['div', 'section', 'ul']))}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(4))) + f"</{t}>"

    for _ in range(150):
        one, two = (wrappers.parse("".join(tree(3) for _ in range(rng.randrange(1, 4)))) for _ in range(2))
        n, pairs = wrappers.simple_tree_match(one, two)
        assert n == brute_match(one, two)
        assert len({id(a) for a, _ in pairs}) == len(pairs) == len({id(b) for _, b in pairs})


def site(k, article):
    return f"<html><body><div class=top>Big Site {k % 2}</div><div><p>{article}</p><p>Read our terms</p></div><div>{['Buy this', 'Sale now'][k % 2]}</div></body></html>"


def test_repeating_slots_are_template(spark):
    """No element says what it is: only the comparison with other pages of the host can tell."""
    pages = [(k, f"http://a.com/{k}", site(k, prose(k, 30))) for k in range(30)]
    out = {r.page_id: r for r in wrappers.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string"), settle).collect()}
    for k in range(30):
        assert out[k].text == prose(k, 30) and out[k].n_chars == len(out[k].text)


def test_copies_of_an_article_are_no_template(spark):
    pages = [(k, "http://a.com/x", f"<body><nav>m</nav><article><h1>Same</h1><p>{prose(1, 40)}</p></article></body>") for k in range(40)]
    out = wrappers.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string"), settle).collect()
    assert {r.text for r in out} == {f"Same {prose(1, 40)}"}


def extracted(spark, pages):
    rows = [(k, f"http://a.com/{k}", page) for k, page in enumerate(pages)]
    return [r.text for r in sorted(wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), settle).collect())]


def test_slots_decide_against_names_and_tags(spark):
    body = [prose(k, 30) for k in range(40)]
    ads = ["Buy this", "Sale now", "Last call"]
    pages = [
        f"<head><title>t {k}</title></head><body><nav>Home {k % 2}</nav><div class=related><p>{body[k]}</p></div><div class=legal>Terms {k % 3}</div><p hidden>no {k}</p></body>"
        for k in range(40)
    ]
    assert extracted(spark, pages) == body
    pages = [f"<body><article><p>{body[k]}</p><h5>{ads[k % 3]}</h5></article><section>more {k}</section><section>Shop {k % 2}</section></body>" for k in range(40)]
    assert extracted(spark, pages) == [f"{body[k]} more {k}" for k in range(40)]
    # Too few pages to overrule what the elements say.
    pages = [f"<body><nav>Home {k}</nav><article><p>{body[k]}</p></article><footer>f {k}</footer></body>" for k in range(8)]
    assert extracted(spark, pages) == body[:8]


def test_every_layout_of_a_host_counts(spark):
    """Whichever pages are references, at least two of the five layouts are not among them."""
    body = [prose(k, 30) for k in range(100)]
    layouts = [
        "<div><div>{0}</div><div>One {1}</div></div>",
        "<table><tr><td>Two {1}</td></tr><tr><td>{0}</td></tr></table>",
        "<section><h2>Three {1}</h2><blockquote>{0}</blockquote></section>",
        "<ul><li>{0}</li></ul><ol><li>Four {1}</li></ol>",
        "<h3>Five {1}</h3><pre>{0}</pre>",
    ]
    assert extracted(spark, [layouts[k % 5].format(body[k], k % 2) for k in range(100)]) == body


def test_deep_trees_are_matched_whole():
    deep = lambda inner: wrappers.parse("<div>" * 200 + inner + "</div>" * 200)
    one, two = deep("<ul><li>a</li></ul><p>b</p><ol><li>c</li></ol>"), deep("<p>x</p><ol><li>y</li></ol><section><p>z</p></section>")
    n, pairs = wrappers.simple_tree_match(one, two)
    assert n == brute_match(one, two) == 206
    assert [(a.text, b.text) for a, b in sorted(pairs, key=lambda p: p[0].text)] == [("b", "x"), ("c", "y")]
    assert wrappers.simple_tree_match(wrappers.parse("<div>" * 5000 + "a"), wrappers.parse("<div>" * 5000 + "b"))[0] == 5002


def test_given_pages(spark, sf_dir):
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = {r.page_id: r.text for r in wrappers.extract_text(pages, settle).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert out[r.page_id] == " ".join(html_module.unescape(re.sub("<[^>]*>", " ", inside)).split())


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, "<p>a", "x"), (None, "u", "", None), (2, "http://h/1", "<div>" * 3000 + "deep", "x"), (3, "http://h/2", f"<p>{'w ' * 200000}</p>", "x")]
    out = wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), settle).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == [("1", 0), ("1", 1), ("2", 4), ("3", 399999), ("None", 0)]
    assert out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert wrappers.extract_text(spark.createDataFrame([], "page_id long, url string, html string"), settle).count() == 0


def test_references_travel_without_their_texts():
    """A skeleton aligns pages as the whole page did, and is small."""
    pages = [site(k, prose(k, 300)) for k in range(4)] + ["<ul class='a\n b'><li>x</ul>" + "<div>" * 300 + "deep", "text only", "<p hidden>x</p><form>q</form>", " "]
    for page in pages:
        whole, bones = wrappers.parse(page), wrappers.skeleton(page)
        tree = wrappers.reference_tree(bones, 1)
        wrappers._name_paths(whole)
        wrappers._count(whole)
        assert whole.size == tree.size and wrappers.simple_tree_match(whole, tree)[0] == tree.size
        assert [c.name for c in whole.children] == [c.name for c in tree.children]
        assert [(x.path, x.tags) for x in wrappers.leaves(whole)] == [(x.path, x.tags) for x in wrappers.leaves(tree)]
        assert [x.slot for x in wrappers.leaves(tree)] == [(1 << 32) + k for k in range(len(list(wrappers.leaves(tree))))]
    assert len(wrappers.skeleton(pages[0])) < len(pages[0]) / 8


def test_pages_are_not_shuffled_while_hosts_are_few(spark, monkeypatch):
    """And when they are many, the result is the same."""
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.com/{k}", site(k, prose(k, 30))) for k in range(60)], "page_id long, url string, html string")
    settled = {}

    def keep(df, label):
        settled[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return settle(df, label)

    small = wrappers.extract_text(pages, keep)
    assert "strategy=broadcast" in settled["wrapper-blocks"] and "strategy=broadcast" in small._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(wrappers, "SMALL_BYTES", 0)
    large = wrappers.extract_text(pages, settle)
    assert sorted(small.collect()) == sorted(large.collect())
