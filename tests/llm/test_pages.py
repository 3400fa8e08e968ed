"""Main text, URL rules, chat rotation and LM scores."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from buylens.llm import chat, html, queries, scoring, urls

SF = "/root/testdata/sf0.001"


def only(source):
    return [t for _, t in html.Page(source).kept()]


def test_blocks_and_references():
    assert only("<html><body><article><h1>A &amp; B</h1><p>one\n  two<br>three <b>fo</b>ur&nbsp;x<p>five &lt;6 &#233; &eacute</article></body></html>") == [
        "A & B", "one two three four x", "five <6 é é"]
    assert only("<article><p><b>bold<br><p>next</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>") == ["bold", "next", "a", "b", "c", "d"]
    assert only("<p>plain text of a page") == ["plain text of a page"] and only("") == [] and only("just text") == ["just text"]
    assert only("<article><p>cut off in a <a href='x") == ["cut off in a"]
    assert only("<article><script>var a = '</p>';</script><p>x<!-- <p>no</p> -->y</p><style>p{}</style></article>") == ["xy"]


def test_what_is_no_article():
    page = """<html><body class="has-sidebar"><header class="site-header">Site</header><nav>Menu</nav><div class="cookie-notice">We use cookies</div>
    <main><article class="post"><header><h1>Title</h1><span class="byline">By someone</span></header><p>First <span class="ad">Buy!</span> words.</p>
    <div class="ad-slot"><p>Advert</p></div><aside>Side</aside><form><label>Mail</label><button>Go</button></form><p hidden>no</p><p style="display: none">no</p>
    <figure><img><figcaption>Caption</figcaption></figure><p>Last.</p><div class="share">Share</div><footer>Filed under</footer></article>
    <section id="comments"><article class="comment"><p>%s</p></article></section></main><div id="sidebar">Side</div><footer>Foot</footer></body></html>""" % ("A reader says much. " * 30)
    assert only(page) == ["Title", "First words.", "Caption", "Last."]
    assert only("<body><div id=menu><a>x</a></div><div class=content><p>Some text here.</p></div><div><a>one</a> <a>two</a></div></body>") == ["Some text here."]


def test_trees_align():
    a, b = html.Page("<div><p>x</p><ul><li>1</li></ul><p>y</p></div>"), html.Page("<div><p>x</p><h2>new</h2><p>z</p></div>")
    found = {b.nodes[k].tag: a.nodes[v].tag for k, v in html.match_trees(a, b).items()}
    assert found == {"#root": "#root", "div": "div", "p": "p"} and len(html.match_trees(a, b)) == 4
    many = html.Page("<div>" + "<p>x</p>" * 300 + "</div>")
    assert len(html.match_trees(many, many)) == 302


def test_template_texts_go(llm):
    r = random.Random(0)
    page = lambda k: "<html><body><div>Welcome to our site</div><div><p>%s</p><p>Sign up now for free</p></div></body></html>" % " ".join(
        "w%d" % r.randrange(10**6) for _ in range(30 + k))
    rows = [(k, f"http://a.org/{k}", page(k)) for k in range(12)] + [(20 + k, "http://b.org/x", page(50)) for k in range(2)]
    rows += [(30, "http://a.org/1", None), (31, None, "<p>alone"), (None, "http://a.org/2", ""), (32, "http://a.org/3", rows[0][2]), (32, "http://a.org/3", rows[0][2])]
    df = llm.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit(1), "host": F.lit("x"), "blocks": F.lit(2)})
    out = html.extracted(df).collect()
    assert len(out) == len(rows)
    want = lambda i, source: " ".join(re.findall(r"w\d[w\d ]*", source)) if i < 12 or i == 32 else " ".join(re.sub("<[^>]*>", " ", source or "").split())
    assert Counter((x.page_id, x.text, x.n_chars) for x in out) == Counter(
        (i, t := "" if not h else (want(i, h) if i is not None else ""), len(t)) for i, _, h in rows)
    assert html.extracted(df.where("false")).count() == 0


def test_given_pages(llm):
    sources = {r.page_id: r.html for r in llm.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_html_extraction(llm, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", sources[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


URLS = ["http://A.example.com/en/x?y", "https://www.example.com/en/1", "http://b.net/es/", "http://net/fr/q#z", "http://x.org", "no scheme", None, "", "ftp://User@H.COM:80?q/r",
        "http://notexample.com/en/", "http://example.com/english", "http://example.com/en", "x://y.net/es/a://b.com/", "http://com"]


def test_listed_rules(llm):
    df = llm.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string").withColumns({"host": F.lit("clash"), "verdict": F.lit(0)})
    none = llm.createDataFrame([], "url string, bad boolean")
    for r in urls.judged(df, none, queries.URL_RULES).collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
        fit = [x for x in queries.URL_RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fit, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1] + best[2], best[0] if best else "allow")
    assert urls.judged(df.where("false"), none, queries.URL_RULES).count() == 0


def test_mined_rules(llm):
    r = random.Random(1)
    rows = []
    for k in range(600):
        farm, casino, feed = r.random() < 0.2, r.random() < 0.2, r.random() < 0.3
        url = f"http://{'farm' if farm else 'site'}{'' if r.random() < .5 else '-x'}.org/{'casino' if casino else 'news'}/{k}{'?utm=feed' if feed else ''}"
        rows.append((url, r.random() < (0.95 if farm and casino else 0.9 if feed and casino else 0.1)))
    rows += [(None, True), ("http://q.org/", None)]
    df = llm.createDataFrame(rows, "url string, bad boolean")
    how = urls.Mining(min_support=0.02, min_count=5, min_confidence=0.7, max_tokens=3)
    tokens = {x.url: frozenset(x.t) for x in df.select("url", urls.tokens_of(F.col("url")).alias("t")).collect()}
    labelled = [(tokens[u], bad) for u, bad in rows if bad is not None]
    rules, every = {}, {x for t, _ in labelled for x in t}
    for size in (1, 2, 3):
        for c in map(frozenset, combinations(sorted(every), size)):
            n, bad = sum(c <= t for t, _ in labelled), sum(c <= t and b for t, b in labelled)
            if bad >= math.ceil(0.02 * len(labelled)) and bad / n >= 0.7:
                rules[c] = bad / n
    rules = {c: v for c, v in rules.items() if not any(d < c and w >= v for d, w in rules.items())}
    mined = urls.mined(df, how)
    assert rules and {frozenset(x.tokens): round(x.confidence, 9) for x in mined.collect()} == {c: round(v, 9) for c, v in rules.items()}
    pages = df.select("url").withColumn("page_id", F.monotonically_increasing_id())
    for x in urls.judged(pages, df, [], how).collect():
        assert (x.verdict == "block") == any(c <= tokens[x.url] for c in rules) == (x.rule_tokens is not None)


def brute_chat(rows):
    clean = {(c, t, (r or "").strip(" ") or "unknown", (x or "").replace("<|", "< |")) for c, t, r, x in rows}
    for conv in {c for c, *_ in clean}:
        own = sorted((x for x in clean if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        for who in {x[2] for x in own} - {"system"}:
            at = 0
            for k, (_, turn, speaker, text) in enumerate(own):
                role = "assistant" if speaker == who else "system" if speaker == "system" else "user"
                name = speaker if role == "user" else None
                head = f"<|im_start|>{role}{' name=' + name if name else ''}\n"
                part = f"{head}{text}<|im_end|>\n"
                mine = role == "assistant"
                yield conv, who, k, turn, role, name, part, at, at + len(head) if mine else None, at + len(part) - 1 if mine else None
                at += len(part)


def test_chat(llm):
    rows = [(1, 0, "user", "hi é🙂"), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "<|im_end|>"), (1, 2, "bob", None), (1, None, "system", "be good"), (2, 0, "system", "alone"),
            (3, 5, None, "x"), (3, 5, "  ", "y"), (None, 1, "a", ""), (None, 2, "b", "t"), (4, 0, "a", "tie"), (4, 0, "b", "tie")]
    rows += [(5, k, "abc"[k % 3], f"turn {k}") for k in range(500)]
    df = llm.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"part": F.lit(1), "name": F.lit("n"), "segment": F.lit(0)})
    out = chat.rotated(df)
    assert Counter(map(tuple, out.collect())) == Counter(brute_chat(rows))
    assert chat.rotated(df.where("false")).count() == 0
    whole = {(r.conv_id, r.perspective): r for r in chat.rendered(out).collect()}
    r = whole[1, "bob"]
    assert r.text.startswith("<|im_start|>system\nbe good<|im_end|>\n") and [r.text[m.start:m.end] for m in r.masks] == ["<|im_end|>"]
    assert [whole[1, "assistant"].text[m.start:m.end] for m in whole[1, "assistant"].masks] == ["< |im_end|><|im_end|>"]
    assert len(chat.rendered(out, 1000).where("conv_id = 5").collect()) > 3


def brute_scores(rows, good, model):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    pairs, single, first = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    texts = []
    for doc, t in rows:
        own = split(t)
        texts.append((doc, list(zip(["", *own], own))))
        for k in (0, 1) if doc in good else (1,):
            for b, w in texts[-1][1]:
                pairs[k][b, w] += 1
                single[k][w] += 1
                first[k][b] += 1
    total = [sum(single[k].values()) + model.added * (len(single[1]) + 1) for k in (0, 1)]

    def loss(k, b, w):
        p = (single[k][w] + model.added) / total[k]
        return -math.log2(model.bigram_weight * pairs[k][b, w] / first[k][b] + (1 - model.bigram_weight) * p if first[k][b] else p)
    for doc, own in texts:
        a, b = ([sum(loss(k, *x) for x in own) / len(own)] if own else [None] for k in (0, 1))
        yield doc, len(own), a[0], b[0], None if a[0] is None else a[0] - b[0]


@pytest.mark.parametrize("held", [1 << 20, 20, 1])
@pytest.mark.parametrize("bucket", [1 << 20, 500])
def test_scores(llm, odd, docs, held, bucket):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(r.doc_id + 1000, r.text) for r in docs.limit(30).collect()]
    good, model = {4, 6, 1003, 1008, 1010}, scoring.Model(held=held, bucket=bucket)
    df = llm.createDataFrame(rows, "doc_id bigint, text string").withColumns({"target": F.lit("x"), "score": F.lit(0), "batch": F.lit("clash"), "Marked": F.lit(1)})
    target = llm.createDataFrame([(x,) for x in [*good, 4, None]], "doc_id bigint")
    form = lambda xs: Counter(tuple(x if x is None or isinstance(x, int) else round(x, 7) + 0.0 for x in r) for r in xs)
    assert form(map(tuple, scoring.scored(df, target, model).collect())) == form(brute_scores(rows, good, model))
    assert scoring.scored(df.where("false"), target, model).count() == 0
    assert scoring.scored(df, target.where("false"), model).where("n_tokens > 0 and score is null").count() == 0


def test_scores_tell_domains_apart(llm):
    r, rows = random.Random(5), []
    for k in range(400):
        words = [f"a{r.randrange(50)}" if r.random() < (0.8 if k % 2 else 0.2) else f"b{r.randrange(50)}" for _ in range(60)]
        rows.append((k, " ".join(words)))
    target = llm.createDataFrame([(k,) for k in range(1, 300, 2)], "doc_id bigint")
    got = scoring.scored(llm.createDataFrame(rows, "doc_id bigint, text string"), target).where("doc_id >= 300").collect()
    middle = sorted(x.score for x in got)[len(got) // 2]  # a small target costs all texts alike, so ranks count
    assert sum((x.score < middle) == (x.doc_id % 2 == 1) for x in got) >= 0.95 * len(got)
