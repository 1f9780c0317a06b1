import html
import random
import re

import pytest
from trajgraph.llm import html_extract as H
from trajgraph.llm.html_extract import extract, main_text, op2_html_extract

LONG = "This is the story, told in full, with enough words, commas and length to count as a paragraph of its own."
MORE = "A second paragraph goes on, since stories do, and it has no links at all but some commas, too."


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{x:0}}</style></head><body>{body}</body></html>"


CASES = {
    "article": (page(f"<nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>foot</footer>"), f"Head {LONG} Short."),
    "divs": (page(f"<div id=menu><ul><li><a>a</a></li></ul></div><div class='content'><p>{LONG}</p><p>{MORE}</p></div><div class=sidebar><p>{LONG}</p></div>"), f"{LONG} {MORE}"),
    "siblings": (page(f"<h2>Title</h2><div class=text><p>{LONG}</p><p>{MORE}</p></div><div class=story><p>{MORE}</p><p>{LONG}</p></div>"), f"Title {LONG} {MORE} {MORE} {LONG}"),
    "comments": (page(f"<main><article><h1>H</h1><p>{LONG}</p></article><section id=comments><article class=comment><p>{LONG}</p></article></section></main>"), f"H {LONG}"),
    "inside": (page(f"<article><header><h1>H</h1></header><aside>side</aside><div class='ad-box'>x</div><p>{LONG}</p><form><input><label>mail</label></form><div class='cookie-notice'>c</div><script>var a='<p>no</p>';</script><p>{MORE}</p><div class='share'>s</div></article>"), f"H {LONG} {MORE}"),
    "open tags": (f"<body><article><h1>H</h1><p><b>{LONG}<br><p>{MORE}<br>x</article><footer>no", f"H {LONG} {MORE} x"),
    "cut": (f"<html><body><article><p>{LONG}</p><p>cut he", f"{LONG} cut he"),
    "references": (page("<article><p>a &amp;&amp; b &lt;i&gt; caf&eacute; &#8364;&#x41; &amp &am &nbsp; x</p></article>"), "a && b <i> café €A & &am x"),
    "inline": (page("<article><p>one<b>two</b><a href=x>three</a> four<span>five</span></p><ul><li>six</li><li>seven</li></ul></article>"), "onetwothree fourfive six seven"),
    "links": (page(f"<div><p><a href=1>{LONG}</a></p><p><a href=2>{MORE}</a></p></div><div><p>{MORE}</p><p>{LONG}</p></div>"), f"{MORE} {LONG}"),
    "menu in article": (page(f"<article><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul><p>{LONG}</p></article>"), LONG),
    "hidden": (page(f"<article><p style='display: none'>no</p><p hidden>no</p><p aria-hidden=true>no</p><p>{LONG}</p></article>"), LONG),
    "quotes": (page(f"<article><p title='a > b' data-x=\"<p>\">{LONG}</p></article>"), LONG),
    "table": (page(f"<article><table><tr><td>a<td>b<tr><td>c</table><p>{LONG}</p></article>"), f"a b c {LONG}"),
    "plain": ("just text, no tags", "just text, no tags"),
    "signs": ("a < b and <3 c > d", "a < b and <3 c > d"),
    "empty": ("", ""),
    "nothing": (page("<nav><a>x</a></nav><script>y</script>"), ""),
    "comment": ("<!-- open <p>never</p>", ""),
    "white": (page("<article><p>\n a \t b\n\n c\xa0d </p>\n<p> e</p></article>"), "a b c d e"),
    "form around": (page(f"<form><div class=content><article><p>{LONG}</p></article></div><input></form>"), LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    source, want = CASES[name]
    assert main_text(source) == want


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + LONG + "</div>" * 20_000) == LONG
    assert main_text("<p>" + "word " * 300_000) == ("word " * 300_000).strip()
    assert main_text("<" * 50_000 + "a") is not None
    assert main_text("<a b='" * 20_000) is not None
    assert main_text("<table><tr><td>" * 5_000 + LONG) == LONG


def test_query_against_the_article_element(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op2_html_extract(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, "u", None, "x"), (1, None, CASES["article"][0], "x"), (1, None, CASES["article"][0], "x"), (None, "v", "<p>é🙂", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract(df).collect()), key=repr)
    want = CASES["article"][1]
    assert got == sorted([(1, "u", "", 0), (1, None, want, len(want)), (1, None, want, len(want)), (None, "v", "é🙂", 2)], key=repr)
    assert extract(df.limit(0)).count() == 0


def test_the_article_stays_whole():
    page = "<nav>menu</nav><article><h1>Head</h1><p>Some text, told at length.</p><h2>Tools</h2><ul>" + "".join(
        f"<li><a href=x>{n}</a></li>" for n in ("Saw", "Axe", "Awl")
    )
    page += "</ul><p>So <math><mi>x</mi> = <mn>2</mn></math> holds, and <label>some lab</label> word.</p></article><footer>foot</footer>"
    assert main_text(page) == "Head Some text, told at length. Tools Saw Axe Awl So x = 2 holds, and some lab word."


def brute_scores(page):
    """Points, link shares and container scores straight from the rules, element by element."""
    out, bonus = H._left_out(page, True)
    n = len(page.tag)
    up = lambda i: [i] + (up(page.parent[i]) if i else [])
    runs = [(i, " ".join(t.split()), t) for i, _, t in page.runs if not out[i]]
    inside = lambda e: [(i, t) for i, t, _ in runs if e in up(i)]
    chars = lambda e: sum(len(t) for _, t in inside(e))
    links = lambda e: sum(len(t) for i, t in inside(e) if any(page.tag[a] == "a" for a in up(i)))
    share = lambda e: links(e) / chars(e) if chars(e) else 0.0
    block = lambda i: next((a for a in up(i) if page.tag[a] in H.BLOCK), 0)
    score = [0.0] * n
    for e in range(1, n):
        own = [(t, raw) for i, t, raw in runs if block(i) == e]
        length = sum(len(t) for t, _ in own)
        if not length or out[e] or page.tag[e] in H.HEADINGS:
            continue
        points = (min(1.0, length / 25) + sum(raw.count(",") for _, raw in own) + min(length / 100, 3.0)) * (1 - share(e))
        target = e if page.tag[e] in H._CONTAINERS else page.parent[e]
        for a, part in zip([a for a in up(target) if a], (1, 2, 6, 9, 12)):
            score[a] += points / part
    return {e: (score[e] + bonus[e]) * (1 - share(e)) for e in range(1, n) if page.tag[e] in H._CONTAINERS and chars(e) and not out[e]}


def test_the_best_container_by_brute_force():
    rng = random.Random(4)
    words = "one two, three four, five six seven".split()
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    found = 0
    for _ in range(60):
        parts = []
        for b in range(rng.randint(2, 5)):
            kind = rng.choice(["", ' class="content"', ' class="sidebar"', ' id="x"'])
            body = "".join(
                f"<p>{say(rng.randint(1, 60))}</p>" if rng.random() < 0.7 else f"<p><a href=u>{say(rng.randint(1, 9))}</a> {say(2)}</p>" for _ in range(rng.randint(1, 5))
            )
            parts.append(f"<div{kind}>{body}</div>" if rng.random() < 0.7 else f"<section><div{kind}>{body}</div><p>{say(9)}</p></section>")
        page = H.Page("<body>" + "".join(parts) + "</body>")
        scores = brute_scores(page)
        top = max(scores.values())
        best = min(e for e, v in scores.items() if v == top)
        out, _ = H._left_out(page, True)
        chosen = " ".join(H._text(page, out, [best]).split())
        text = H._scored(page, True)
        found += chosen in text
        # Nothing comes out but the best container and siblings of it.
        beside = [e for e in range(1, len(page.tag)) if page.parent[e] == page.parent[best]]
        assert set(text.split()) <= set(H._text(page, out, beside).split())
        assert chosen in text
    assert found == 60
