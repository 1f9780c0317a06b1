import pytest
from test_html_extract import LONG, MORE, page
from trajgraph.llm.html_extract import main_text

CASES = {
    **{name: (page(f"<div class='content {name}'><p>{LONG}</p><p>{MORE}</p></div>"), f"{LONG} {MORE}") for name in ("has-sidebar", "no-sidebar", "with-sidebar", "no-comments")},
    **{name: (page(f"<article><div class='{name}'><h1>Head</h1></div><p>{LONG}</p></article>"), f"Head {LONG}") for name in ("entry-header", "post-header")},
    "site header": (page(f"<div class=header>Site</div><article><div class=header>By line</div><p>{LONG}</p></article>"), LONG),
    "blog classes": (page(f"<article class='post category-social tag-cookies'><p>{LONG}</p></article>"), LONG),
    "bad article": (page(f"<article class='post social'><h1>H</h1><p>{LONG}</p></article>"), f"H {LONG}"),
    "comment inside": (page(f"<article><p>{LONG}</p><article class='comment'><p>{MORE}</p></article></article>"), LONG),
    "comment section": (page(f"<main><p>{LONG}</p><div class=comments><article class=comment><p>{MORE}</p></article></div></main>"), LONG),
    "nothing left": (page(f"<div class='sidebar-layout'><p>{LONG}</p><p>{MORE}</p></div>"), f"{LONG} {MORE}"),
    "little left": (page(f"<p>Hi.</p><div class='widget'><p>{LONG}</p><p>{MORE}</p></div><nav>n</nav>"), f"Hi. {LONG} {MORE}"),
}


@pytest.mark.parametrize("name", CASES)
def test_class_names(name):
    source, want = CASES[name]
    assert main_text(source) == want
