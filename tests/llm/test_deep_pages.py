"""Pages that nest deep."""

import pytest

from buylens.llm import html


@pytest.mark.parametrize("deep", [10, 200, 5000])
def test_text_after_a_deep_nest(deep):
    embed = "<div>" * deep + "<nav>Menu</nav>in" + "</div>" * deep
    page = html.Page(f"<body><article><p>First.</p>{embed}<p>Last.</p></article><div>Outside</div></body>")
    assert [t for _, t in page.kept()] == ["First.", "in", "Last."]
    assert len(html.match_trees(page, html.Page(f"<body><article><p>Other.</p>{embed}</article></body>"))) == deep + 5
