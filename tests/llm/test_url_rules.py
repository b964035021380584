import re
import time

import pytest

from burstline.llm.op4 import SITES
from burstline.llm.url_rules import MiningParams, judge_urls, mine_rules, url_tokens

URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/x?q=1", "http://www.example.com/de/", "http://a.b.net/es/2#t",
    "http://net/fr/3", "http://xnet/fr/3", "http://example.com", "http://example.com?en/", "no scheme", "", None,
    "ftp://u:p@host.com:80/a/b", "a://b://c/d", "http://example.com/en", "http://m.example.com/en/\nx", "http://É.com/",
]


def site(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in SITES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (not best or len(r.name) > len(best.name)):
            best = r
    return host, path, best.name if best else None, best.verdict if best else "allow"


def labelled(spark):
    rows = [(f"http://{'pills' if i % 3 == 0 else 'news'}.example.org/{'en' if i % 2 else 'de'}/{i}?ref=x",
             i % 3 == 0 and i % 2 == 1 or i % 17 == 0) for i in range(600)]
    return spark.createDataFrame(rows + [(None, True), ("http://x.org/", None)], "url string, bad boolean")


def test_listed_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "?") for i, u in enumerate(URLS)] + [(0, URLS[0], "?")], "page_id long, url string, rule string")
    none = mine_rules(labelled(spark).where("bad is null"))
    got = judge_urls(pages, none, SITES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == site(URLS[r.page_id])
    assert judge_urls(pages.limit(0), none, SITES).count() == 0


def test_mined_rules_against_brute_force(spark):
    rows = labelled(spark)
    params = MiningParams(min_support=0.05, min_rows=10, min_confidence=0.7)
    rules = mine_rules(rows, params).collect()
    assert rules
    known = [(set(r.items), r.bad) for r in rows.where("url is not null and bad is not null")
             .select(url_tokens(rows.url).alias("items"), "bad").collect()]
    for r in rules:
        hold = [bad for items, bad in known if set(r.antecedent) <= items]
        assert r.confidence == pytest.approx(sum(hold) / len(hold)) and r.confidence >= 0.7
        assert sum(hold) >= 0.05 * len(known) and r.key in r.antecedent
        assert not any(set(o.antecedent) < set(r.antecedent) and o.confidence >= r.confidence for o in rules)
    pages = spark.createDataFrame([(i, f"https://{h}.example.org/{l}/9") for i, (h, l) in enumerate(
        [("pills", "en"), ("pills", "de"), ("news", "en"), ("news", "de")])], "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(pages, mine_rules(rows, params), []).collect()}
    tokens = {r.page_id: set(r.items) for r in pages.select("page_id", url_tokens(pages.url).alias("items")).collect()}
    for i, r in got.items():
        assert (r.verdict == "block") == any(set(x.antecedent) <= tokens[i] for x in rules)
    assert got[0].verdict == "block" and got[3].verdict == "allow"


def test_many_shared_tokens_are_mined_in_seconds(spark):
    words = "/".join(f"w{k}x" for k in "abcdefghijklmnopqrst")  # twenty tokens that all urls hold
    always = "-".join(f"v{k}y" for k in "abcdefghijklmnopqrst")  # and twenty that always come together
    rows = [(f"http://s{i % 7}.org/{words}/{'casino' if i % 4 == 0 else 'garden'}/{always if i % 3 else 'plain'}/{i}",
             i % 4 == 0 and i % 20 != 0) for i in range(600)]
    start = time.perf_counter()
    rules = mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), MiningParams(min_rows=10)).collect()
    assert time.perf_counter() - start < 60
    assert ["p=casino"] in [r.antecedent for r in rules] and all(r.confidence >= 0.6 for r in rules)
    judged = judge_urls(spark.createDataFrame([(1, "http://new.net/casino"), (2, "http://new.net/garden")], "page_id long, url string"),
                        spark.createDataFrame(rules), SITES)
    assert {r.page_id: r.verdict for r in judged.collect()} == {1: "block", 2: "allow"}
