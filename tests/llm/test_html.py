"""Main text: pages where names mislead, the tokenizer's rules, linear time, and density against a plain version."""

import random
import time
from math import e, log

import pytest

from damhwa.llm import html_density as H

TEXT = "Sentence of some length, with words that tell and no links at all."
P = f"<p>{TEXT}</p>"


@pytest.mark.parametrize("wrap", [
    '<div class="layout has-sidebar">{}</div>', '<div class="post ad-free">{}</div>', '<div id="search-results-explained">{}</div>', '<div class="with-comments"><article>{}</article></div>', '<div class="sidebar"><main>{}</main></div>',
])
def test_names_of_layouts_do_not_drop_the_text(wrap):
    html = f"<body><nav><a href=a>Home</a></nav>{wrap.format(P * 3)}<footer>&copy; us</footer></body>"
    assert H.main_text(html).split("\n") == [TEXT] * 3


def test_text_within_the_article_stays():
    assert H.main_text(f'<article>{P}<p class="alert">{TEXT} Really.</p>{P}</article>').split("\n") == [TEXT, f"{TEXT} Really.", TEXT]
    assert H.main_text(f"<article>{P}<p>The <label>word</label> in the middle of a long enough line of text.</p></article>").split("\n")[1] == "The word in the middle of a long enough line of text."
    assert H.main_text(f"<article><p title=don't>Alpha text.</p><p>Bob's beta, which is long enough to be read.</p>{P}</article>").split("\n")[:2] == ["Alpha text.", "Bob's beta, which is long enough to be read."]


def test_density_decides_without_article():
    links = "".join(f"<li><a href=x{k}>Some other story, number {k}</a></li>" for k in range(12))
    html = f"<body><div class=top><a href=/>Site</a> <a href=/x>More</a></div><div><h2>Head of it</h2>{P * 5}</div><div><ul>{links}</ul></div><p>Legal.</p></body>"
    assert H.main_text(html).split("\n") == ["Head of it", *[TEXT] * 5]


def test_long_comments_are_not_the_text():
    comments = "".join(f"<li><article><p>{TEXT} {TEXT} {k}</p></article></li>" for k in range(30))
    html = f'<body><div><article><h1>Title</h1>{P * 2}</article><div id="comments"><ol>{comments}</ol></div></div></body>'
    assert H.main_text(html).split("\n") == ["Title", TEXT, TEXT]


def test_tokens():
    cases = {
        "a < b and c > d": "a < b and c > d", "x<b": "x", "<p>a<!-- open <p>b": "a", "<p>a<script>never ends": "a", '<p class="open>lost</p>': "",
        "<p>a</p foo=bar>b": "a\nb", "<P>a<BR/>b</P>": "a b", "<div/>a": "a", "<p>1 &lt; 2 &amp; &#x41;</p>": "1 < 2 & A", "<?xml x?><p>a</p>": "a", "<p a = \"<b>\" c='>'>ok</p>": "ok", "": "", None: "",
    }
    for html, want in cases.items():
        assert H.main_text(html) == want, html


@pytest.mark.parametrize("html", [
    "<div class=x>" * 50_000, "<a " * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<u><div>" + "<b>" * 30_000 + "</u>" * 30_000, "<table>" + "<b>" * 30_000 + "<hr>" * 30_000, "<a b='" * 50_000, "<!--" * 50_000, "<script>" * 50_000, "<" * 100_000,
    "<ul>" + "<div>" * 30_000 + "<li>" * 30_000, "</p>" * 50_000, "<div>" * 50_000 + "</section>" * 50_000, "<article>" + "<p class='ad-x'>" * 50_000,
])
def test_linear_time(html):
    began = time.process_time()
    H.main_text(html + "<p>end")
    assert time.process_time() - began < 8


def _plain(html):
    """Densities from a recursive walk of their own: (tag, density) in order."""
    out = []

    def walk(node, in_link):
        in_link = in_link or node.tag == "a"
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        at = len(out)
        out.append(None)
        c, t, lc, lt = own, 1, own if in_link else 0, node.tag == "a"
        for child in node.children:
            if not isinstance(child, str):
                c2, t2, lc2, lt2 = walk(child, in_link)
                c, t, lc, lt = c + c2, t + t2, lc + lc2, lt + lt2
        out[at] = (node, c, t, lc, lt)
        return c, t, lc, lt

    root = H.parse(html)
    c, _, lc, _ = walk(root, False)
    ratio = lc / c if c else 0.0

    def value(c, t, lc, lt):
        if not c:
            return 0.0
        inner = log(lc / max(1, c - lc) * c + ratio * c + e)
        x = log(max(1.0, (c / max(1, lc)) * (t / max(1, lt))))
        return c / t * (x / log(inner) if log(inner) > 1 else x)

    return root, {id(n): value(*rest) for n, *rest in out}, ratio


def test_density_equals_plain_version():
    rng = random.Random(2)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 40)):
            parts.append(rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<b>", "</b>", "<ul><li>", "</ul>", "word " * rng.randint(1, 30)]))
        root, plain, ratio = _plain("".join(parts))
        nodes = H._ordered(root)
        H._count(nodes)
        for n in nodes:
            assert H.density(n, ratio) == pytest.approx(plain[id(n)])


def test_extract_edges(spark):
    rows = [(1, "u", f"<article>{P}</article>", "t", 5), (1, "u", f"<article>{P}</article>", "t", 5), (2, None, None, None, None), (None, "v", "", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(str, H.extract(df).collect()))
    assert got == sorted(map(str, H.extract(df.select("page_id", "url", "html")).collect())) and len(got) == 4
    assert H.extract(df.where("false")).count() == 0
