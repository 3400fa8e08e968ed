"""Tree matching against plain recursion, markup that is easily misread, and long pages."""

import random
import time

import pytest

from buylens.llm import html


def only(source):
    return [t for _, t in html.Page(source).kept()]


def plain(a, b):
    """Simple tree matching as it is defined."""
    if a.shape != b.shape:
        return 0
    xs, ys = ([c for c in x.elements if c.tag != "br"] for x in (a, b))
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + plain(x, y))
    return table[-1][-1] + 1


def tree(r, depth=0):
    tag = r.choice(["div", "section", "span", "b", "br"])
    if tag == "br":
        return "<br>"
    inner = "".join(tree(r, depth + 1) for _ in range(r.choice([0, 1, 2, 3, 5]) if depth < 4 else 0))
    return f"<{tag}>{inner}</{tag}>"


def is_match(a, b, found):
    """Equal shapes, parents with parents, and the order of children kept."""
    for y, x in found.items():
        p, q = a.nodes[x], b.nodes[y]
        assert p.shape == q.shape
        if q.parent is not None:
            assert found[q.parent.number] == p.parent.number
        places = [found[c.number] for c in q.placed if c.number in found]
        assert places == sorted(set(places))


@pytest.mark.parametrize("short", [24, 2])
def test_random_trees(short, monkeypatch):
    monkeypatch.setattr(html, "SHORT", short)
    r, matcher = random.Random(8), html.Matcher()
    a = html.Page(tree(r))
    matcher.name(a)
    for k in range(150):
        if k % 10 == 0:
            a = html.Page("<div>" + "".join(tree(r) for _ in range(6)) + "</div>")
            matcher.name(a)
        b = html.Page("<div>" + "".join(tree(r) for _ in range(r.randrange(8))) + "</div>")
        found = html.match_trees(a, b, matcher)
        assert len(found) == plain(a.root, b.root)
        is_match(a, b, found)


def test_long_lists_of_children_are_matched_exactly():
    r = random.Random(3)
    row = lambda n: "".join(f"<{r.choice(['p', 'div', 'span', 'b'])}></{'x'}>" for _ in range(n))
    flat = lambda n: "<main>" + "".join(f"<section class={r.choice('abcd')}></section>" for _ in range(n)) + "</main>"
    for n in (30, 210, 400):
        a, b = html.Page(flat(n)), html.Page(flat(n))
        xs, ys = ([c.shape for c in p.root.elements[0].elements] for p in (a, b))
        line = [0] * (len(ys) + 1)
        for x in xs:
            last = line
            line = [0]
            for j, y in enumerate(ys):
                line.append(last[j] + 1 if x == y else max(last[j + 1], line[j]))
        found = html.match_trees(a, b)
        assert len(found) == line[-1] + 2
        is_match(a, b, found)
    assert row(1)


def test_quotes_and_comments():
    assert only("<article><p title=Bob's>Beta two.</p><p>Gamma three.</p></article>") == ["Beta two.", "Gamma three."]
    assert only("<article><p a'b=1 \"c>One</p><p title = 'x>y' z>Two</p><p title=\"a>b\"class=x>Three</p></article>") == ["One", "Two", "Three"]
    assert only("<article><p>a<!-- no --!> b</p><p>c<!-->d<!--->e<!-- --- > -->f</p></article>") == ["a b", "cdef"]
    assert only("<article><p x= >One</p><p =y>Two</p></ p><br/>Three</article>") == ["One", "Two", "Three"]


def test_parts_of_an_article_with_names_like_boilerplate():
    page = """<article><h1>T</h1><div class="social-history"><p>Social history.</p></div><div class="legal-text"><p>Of the law.</p></div>
    <section class="related-work"><p>Others did this.</p></section><section id="discussion"><h2>Discussion</h2><p>We discuss.</p></section>
    <div class="discussion"><div><b>Ann</b> wrote</div><div>Nice</div></div><div class="related-posts"><p>More</p></div><div class="user-comments"><p>Hm</p></div>
    <div class="cookie-notice-bar"><p>We use cookies</p></div><div class="adBox"><p>Buy</p></div></article>"""
    assert only(page) == ["T", "Social history.", "Of the law.", "Others did this.", "Discussion", "We discuss."]


def test_story_in_several_articles():
    page = "<main><article><h1>Part one</h1><p>Long text of the first part.</p></article><article><h2>Part two</h2><p>Its text.</p></article><article class=comment><p>Hm</p></article></main>"
    assert only(page) == ["Part one", "Long text of the first part.", "Part two", "Its text."]


def test_long_pages_take_linear_time():
    start = time.time()
    page = html.Page("<article><p>" + "<b>x</b> y " * 400_000 + "</p>" + "<p>word word</p>" * 100_000 + "</article>")
    assert len(page.kept()) == 100_001
    other = html.Page("<article>" + "<p>word word</p>" * 3000 + "<h2>a</h2>" + "<p>x</p>" * 3000 + "</article>")
    assert len(html.match_trees(page, other)) == 6002
    for attributes in ("a ", "a= ", "a='", '"', "=", "/"):
        html.Page("<p " + attributes * 200_000)
    assert time.time() - start < 60
