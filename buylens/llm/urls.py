"""URL filter by association rules.

Spark's FP-growth finds combinations of URL tokens that often occur with a bad label. A combination becomes a rule if enough labelled URLs have it and
enough of those are bad, and if no part of it is a rule already that is as sure. Rules are matched by an inverted index: each is filed under its rarest token,
so a URL looks up its own tokens and checks the rest of the few rules it meets. Tokens that stand on the same labelled URLs are one item to the mining.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import stored

BAD = "label:bad"


@dataclass(frozen=True)
class Mining:
    """Share of labelled URLs that an itemset needs, with a count below which no rule is made; share of bad ones; longest combination, None for any."""

    min_support: float = 0.002
    min_count: int = 20
    min_confidence: float = 0.8
    max_tokens: int | None = None


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _marked(mark: str, words: Column) -> Column:
    """Words with their mark in front; any number is one word."""
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), "#").otherwise(w)))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, words of the path and of the query, each marked with its place; numbers are one token."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*://[^?#]*\?([^#]*)", 1)
    word = r"[^\p{L}\p{N}]+"
    return F.array_sort(F.array_distinct(F.concat(
        _marked("h:", F.split(host_of(url), r"[.\-:@]")), _marked("p:", F.split(F.lower(path_of(url)), word)), _marked("q:", F.split(F.lower(query), word)))))


def classes_of(rows: DataFrame, least: int) -> DataFrame:
    """(name, members, n) of the tokens on at least ``least`` rows of (row, tokens): tokens that are on exactly the same rows are one class, by its first token.

    Rows are told apart by two 64-bit fingerprints of their set and by its size.
    """
    marks = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"mark_{k}") for k in (1, 2)]
    each = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks).where(F.col("n") >= least)
    return each.groupBy("n", "mark_1", "mark_2").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.col("members")[0].alias("name"), "members", "n")


def mined_classes(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """(parts, rarest, size, support, confidence) from (url, bad): a rule asks for one token of each of its ``parts``; ``rarest`` is its rarest part.

    Every row with a label counts; null labels are left out. Tokens that always stand together are mined as one, and a token of every row not at all
    beside others: neither changes what rows a combination has, so no rule is lost, and combinations of them aren't enumerated.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.where(F.col("bad").isNotNull()).select(F.monotonically_increasing_id().alias("row"), tokens_of(F.col("url")).alias("tokens"), "bad"), "labelled")
    total, bad_total = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.count_if("bad")).first())
    empty = "select array(array('')) parts, array('') rarest, 0 size, 0L support, 0D confidence where false"
    least = max(how.min_support, how.min_count / total) if total else 2.0
    if least > 1:
        return spark.sql(empty)
    classes = stored(classes_of(rows, math.ceil(least * total - 1e-9)), "token-classes")
    varied = classes.where(F.col("n") < total)
    named = rows.select("row", "bad", F.explode("tokens").alias("name")).join(varied.select("name"), "name").groupBy("row", "bad").agg(F.collect_list("name").alias("items"))
    items = stored(named.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "items")
    # Rows without any of the tokens are no transactions here, so the support is stated as a count of all.
    held = items.count()
    if held:
        # Half a row less, so that rounding up gives the count itself.
        share = min(1.0, (math.ceil(least * total - 1e-9) - 0.5) / held)
        # Whatever is frequent together with the label is frequent without it, so every rule finds its own support among the itemsets.
        frequent = FPGrowth(itemsCol="items", minSupport=share, minConfidence=1.0).fit(items).freqItemsets
        sets = frequent.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    else:
        sets = spark.sql("select array('') items, 0L n where false")
    every = classes.where(F.col("n") == total).select("name")
    alone = every.select(F.array("name").alias("items"), F.lit(total).cast("bigint").alias("n")).unionByName(
        every.where(F.lit(bad_total >= least * total - 1e-9)).select(F.array_sort(F.array("name", F.lit(BAD))).alias("items"), F.lit(bad_total).cast("bigint").alias("n")))
    sets = stored(sets.unionByName(alone), "itemsets")
    fits = F.lit(True) if how.max_tokens is None else F.size("items") <= how.max_tokens + 1
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1) & fits).select(
        F.array_remove("items", BAD).alias("tokens"), F.col("n").alias("bad_n"))
    rated = bad.join(sets.withColumnRenamed("items", "tokens"), "tokens").withColumn("confidence", F.col("bad_n") / F.col("n"))
    rated = stored(rated.withColumn("sure", F.when(F.col("confidence") >= how.min_confidence, F.col("confidence"))), "rated")
    # Drop a rule if leaving out one or more tokens gives another rule at least as sure: by size, each combination learns the surest rule among its parts.
    level = rated.where(F.size("tokens") == 1).withColumn("below", F.lit(None).cast("double"))
    levels = [level]
    for size in range(2, (rated.agg(F.max(F.size("tokens"))).first()[0] or 0) + 1):
        best = level.select(F.col("tokens").alias("part"), F.greatest("sure", "below").alias("best"))
        parts = rated.where(F.size("tokens") == size).withColumn("part", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))))
        level = stored(parts.join(best, "part").groupBy(*rated.columns).agg(F.max("best").alias("below")), "level")
        levels.append(level)
    rules = reduce(DataFrame.unionByName, levels).where("sure is not null and (below is null or below < sure)")
    parts = rules.select("tokens", "n", "confidence", F.explode("tokens").alias("name")).join(classes.select("name", "members", F.col("n").alias("token_n")), "name")
    return stored(parts.groupBy("tokens", "n", "confidence").agg(
        F.array_sort(F.collect_list("members")).alias("parts"), F.min(F.struct("token_n", "members"))["members"].alias("rarest")).select(
        "parts", "rarest", F.size("parts").alias("size"), F.col("n").cast("bigint").alias("support"), "confidence"), "rules")


def mined(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """(rule_id, tokens, rarest, size, support, confidence): the rules of ``mined_classes`` with one token of each part, every choice a row."""
    choices = F.aggregate("parts", F.expr("array(cast(array() as array<string>))"), lambda acc, part: F.flatten(
        F.transform(acc, lambda chosen: F.transform(part, lambda token: F.array_append(chosen, token)))))
    each = mined_classes(labelled, how).select(F.explode(F.transform(choices, lambda c: F.array_sort(c))).alias("tokens"), "rarest", "size", "support", "confidence")
    return each.select(F.xxhash64("tokens").alias("rule_id"), "tokens", F.array_intersect("tokens", "rarest")[0].alias("rarest"), "size", "support", "confidence")


def matched(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule_tokens, confidence): the surest rule of each page that meets one of ``mined_classes``; ties go to the longer, then the last one.

    A rule is filed under the tokens of its rarest part; a page looks up its own tokens and then checks the other parts.
    """
    index = rules.select(F.explode("rarest").alias("rarest"), "parts", "confidence")
    urls = pages.select(key, tokens_of(F.col("url")).alias("_tokens"))
    hits = urls.withColumn("rarest", F.explode("_tokens")).join(index, "rarest").where(F.forall("parts", lambda part: F.arrays_overlap(part, F.col("_tokens"))))
    tokens = F.array_sort(F.transform("parts", lambda part: F.array_max(F.array_intersect(part, F.col("_tokens")))))
    best = F.max(F.struct("confidence", F.size("parts").alias("size"), tokens.alias("tokens")))
    return hits.groupBy(key).agg(best.alias("best")).select(key, F.col("best.tokens").alias("rule_tokens"), F.col("best.confidence").alias("confidence"))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest of (verdict, host, path) rules whose host is a suffix of labels and whose path is a prefix; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], how: Mining = Mining()) -> DataFrame:
    """``pages`` with host, path, rule, verdict, rule_tokens, confidence.

    A listed rule decides first; else a page that a mined rule matches is blocked, any other allowed. Null or malformed URLs have no tokens and are allowed. Rows
    with the same page_id are judged each by its own URL. Extra columns named like a result are replaced.
    """
    new = ("host", "path", "rule", "verdict", "rule_tokens", "confidence")
    source = pages.select(*[f"`{c}`" for c in pages.columns if c.lower() not in new])
    # Written first, so that the join splits the pages of an address that was crawled very often.
    found = stored(matched(source.select("url").distinct(), mined_classes(labelled, how), "url"), "matched")
    key = tx.free_name(source, "_url")
    joined = source.join(found.withColumnRenamed("url", key), F.col("url") == F.col(key), "left").drop(key)
    own = listed(F.col("host"), F.col("path"), rules)
    return joined.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("_own", own).select(
        *[f"`{c}`" for c in source.columns], "host", "path", F.col("_own.rule").alias("rule"),
        F.coalesce("_own.verdict", F.when(F.col("rule_tokens").isNotNull(), "block").otherwise("allow")).alias("verdict"), "rule_tokens", "confidence")
