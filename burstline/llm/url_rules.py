"""URL filtering: listed site rules first, then association rules mined from labelled URLs.

Spark's FP-growth finds the combinations of URL tokens that go with a bad label: among the tokens of bad rows, without
those that all rows share and with one for all that always come together. Rules are pruned by
support and confidence, and by a shorter rule that is at least as sure. To match, an inverted index
holds each rule under its rarest token: a URL meets only the rules of tokens it has, and the rest of
such a rule is checked on the spot.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstline.lineage import cut

# rules go to every task below this many, else they are joined
SMALL_TABLE = 10_000
# share of all labelled rows from which on a token makes no rule
_EVERYWHERE = 0.99


@dataclass(frozen=True)
class MiningParams:
    min_support: float = 0.002  # share of labelled URLs that hold a rule's tokens and the label
    min_rows: int = 20  # and so many labelled URLs at least, lest chance make rules of small tables
    min_confidence: float = 0.6  # share of bad ones among those that hold its tokens
    max_tokens: int = 4  # tokens in a rule


@dataclass(frozen=True)
class SiteRule:
    host: str  # a domain; its subdomains are meant too
    path: str  # what the path starts with
    verdict: str  # "allow" or "block"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or without '://'."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: each host label with its place from the right, path words, query keys; numbers as '#'."""
    labels = F.reverse(F.split(host_of(url), r"\.", -1))
    host = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x))
    words = F.transform(
        F.filter(F.split(F.lower(path_of(url)), "[^\\p{L}\\p{N}]+", -1), lambda x: x != ""),
        lambda x: F.concat(F.lit("p="), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all(url, F.lit("[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("q="), x))
    scheme = F.array(F.concat(F.lit("s="), F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))))
    return F.array_distinct(F.concat(scheme, host, words, F.coalesce(keys, F.array())))


def site_rule(host: Column, path: Column, rules: list[SiteRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones go in front
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _items(rows: DataFrame, least: float) -> DataFrame:
    """(row, items) of the bad rows: tokens that can make a rule, one for all that occur in the same rows.

    Tokens that fewer than `least` bad rows hold make none, and those that nearly all rows hold (`_EVERYWHERE`) tell
    nothing: either would only multiply the combinations.
    """
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    n = rows.count()
    seen = (each.groupBy("token").agg(
        F.count("*").alias("df"), F.count_if("bad").alias("bad"),
        F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("two"))
        .where((F.col("bad") >= least) & (F.col("df") < _EVERYWHERE * n)))
    chosen = seen.groupBy("df", "one", "two").agg(F.min("token").alias("token")).select("token")
    return each.where("bad").join(chosen, "token").groupBy("row").agg(F.collect_list("token").alias("items"))


def mine_rules(labelled: DataFrame, params: MiningParams = MiningParams()) -> DataFrame:
    """(antecedent, confidence, support, key) from `labelled` (url, bad boolean); `key` is the rarest token.

    Combinations are mined from the bad rows, and then counted in all of them. Of tokens that occur in the same rows,
    the first one stands for all. A null url or label is left out. With fewer than `min_rows` bad rows there are no rules.
    """
    rows = cut(labelled.where("url IS NOT NULL AND bad IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), "bad", url_tokens(F.col("url")).alias("tokens")))
    schema = "antecedent array<string>, confidence double, support double, key string"
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if n_bad < params.min_rows:
        return rows.sparkSession.createDataFrame([], schema)
    least = max(params.min_support * n, params.min_rows)
    items = cut(_items(rows, least))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(items.count(), 1))).fit(items).freqItemsets
    found = cut(found.where((F.size("items") <= params.max_tokens) & (F.col("freq") >= least))
                .select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("hits")))
    df = cut(rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")))
    rare = found.select("*", F.explode("antecedent").alias("token")).join(df, "token").groupBy("antecedent", "hits").agg(
        F.min_by("token", F.struct("df", "token")).alias("key"))
    # rows that hold all tokens of a combination are found under its rarest one
    held = (rows.select("tokens", F.explode("tokens").alias("key")).join(rare, "key")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("antecedent", "hits", "key").agg(F.count("*").alias("n")))
    rules = cut(held.withColumn("confidence", F.col("hits") / F.col("n")).where(F.col("confidence") >= params.min_confidence)
                .select("antecedent", "confidence", (F.col("hits") / F.lit(n)).alias("support"), "key"))
    # a rule falls if part of it is a rule that is as sure: parts are looked up by their content
    part = F.posexplode("antecedent").alias("at", "without")
    fewer = (rules.select("antecedent", "confidence", part)
             .select("antecedent", "confidence", F.array_except("antecedent", F.array("without")).alias("part"))
             .join(rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("other")), "part")
             .where("other >= confidence").select("antecedent").distinct())
    return cut(rules.join(fewer, "antecedent", "left_anti").select("antecedent", "confidence", "support", "key"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence, antecedent) of the surest rule for each distinct url that one fits."""
    if rules.count() <= SMALL_TABLE:
        rules = F.broadcast(rules)
    return (urls.where("url IS NOT NULL").select("url", url_tokens(F.col("url")).alias("tokens"))
            .select("url", "tokens", F.explode("tokens").alias("key")).join(rules, "key")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0)
            .groupBy("url").agg(F.max(F.struct("confidence", "antecedent")).alias("hit"))
            .select("url", "hit.confidence", "hit.antecedent"))


def judge_urls(pages: DataFrame, rules: DataFrame, sites: list[SiteRule], *, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """One row per row of `pages`: page_id, url, host, path, rule, verdict, mined (the mined rule's tokens), confidence.

    A listed rule decides where one fits; else a mined rule that fits blocks, and all others are allowed.
    Defined cases: a null url, or one without '://', has empty host and path; repeated rows are judged
    each; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    hits = cut(matched(rows, rules))
    if hits.count() <= SMALL_TABLE:
        hits = F.broadcast(hits)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = site_rule(F.col("host"), F.col("path"), sites)
    return (rows.join(hits.withColumnRenamed("antecedent", "mined"), "url", "left")
            .withColumn("host", host).withColumn("path", path)
            .select("page_id", "url", "host", "path", name.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                    "mined", "confidence"))
