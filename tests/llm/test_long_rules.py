"""URL rules of many tokens."""

from buylens.llm import urls


def test_rule_that_needs_five_tokens(llm):
    words = [f"t{k}" for k in range(5)]
    rows = [("http://x/" + "/".join(words), True)] * 40
    rows += [("http://x/" + "/".join([*words[:k], "z", *words[k + 1:]]), False) for k in range(5) for _ in range(40)]
    mined = urls.mined(llm.createDataFrame(rows, "url string, bad boolean"), urls.Mining(min_support=0.01)).collect()
    assert [sorted(t[-2:] for t in r.tokens) for r in mined] == [words]
