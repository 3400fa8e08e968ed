"""Templates of hosts with several layouts, partial notices and few pages."""

import random

from buylens.llm import html


def texts(llm, rows):
    df = llm.createDataFrame([(k, f"http://{host}/{k}", source) for k, (host, source) in enumerate(rows)], "page_id bigint, url string, html string")
    return [r.text for r in sorted(html.extracted(df).collect(), key=lambda r: r.page_id)]


def words(r, n=30):
    return " ".join("w%d" % r.randrange(10**6) for _ in range(n))


def test_notice_that_the_reference_may_lack(llm):
    r = random.Random(1)
    own = [words(r) for _ in range(20)]
    rows = [("a.org", f"<article>{'<section><p>Read this first</p></section>' if k % 5 < 3 else ''}<p>{t}</p></article>") for k, t in enumerate(own)]
    assert texts(llm, rows) == own


def test_layouts_of_a_host(llm):
    r = random.Random(2)
    own = [words(r) for _ in range(24)]
    rows = [("b.org", f"<body><div class='frame{k % 3}'><article><h3>Welcome to part {k % 3}</h3><p>{t}</p></article></div></body>") for k, t in enumerate(own)]
    assert texts(llm, rows) == own


def test_constant_longer_than_the_pages_own_texts(llm):
    r = random.Random(3)
    own, notice = [words(r, 5) for _ in range(8)], "All rights of this text are with us and it may not be printed anywhere else. " * 3
    assert texts(llm, [("c.org", f"<article><p>{t}</p><p>{notice}</p></article>") for t in own]) == own


def test_hosts_of_few_pages(llm):
    r = random.Random(4)
    for n in (2, 3, 4):
        own = [words(r) for _ in range(n)]
        assert texts(llm, [("d.org", f"<article><p>{t}</p><p>Sign up now for free</p></article>") for t in own]) == own
    shared = [words(r) for _ in range(4)]  # near copies keep what they share
    whole = [" ".join([*shared, words(r)]) for _ in range(2)]
    rows = [("e.org", "<article>" + "".join(f"<p>{p}</p>" for p in shared) + f"<p>{t[len(' '.join(shared)) + 1:]}</p></article>") for t in whole]
    assert texts(llm, rows) == whole
    assert texts(llm, [("f.org", "<article><p>Only page</p></article>")]) == ["Only page"]
