from __future__ import annotations

import re

from pyspark.sql import functions as F

from palimpsest.llm import hosts
from palimpsest.llm.hosts import HostConfig
from palimpsest.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x#y", "https://example.net/EN/1", "ftp://b.example.com/de/1", "http://notexample.com/de/1",
    "http://x.org/fr/", "http://x.org?fr/", "http://org#a", "http://net/", "http://net", "://a.b.co.uk/p", "a://b://c/d", "http://x.y.z\n/d\ne?f", "http://É.org/fr/a",
]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def test_parts_and_rules(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"site": F.lit(1), "host": F.lit(2), "row": F.lit(3)})
    df = hosts.judged(rows, URL_RULES)
    assert df.columns == ["page_id", "url", "host", "row", "site"]
    for r in df.collect():
        host, path = parsed(URLS[r["page_id"]])
        rule, verdict = ruled(host, path)
        assert (r["site"]["host"], r["site"]["path"], r["site"]["rule"]) == (host, path, rule)
        assert r["site"]["verdict"] == verdict or rule is None


def test_rates_shrink_towards_domain_and_suffix(spark):
    outcomes = [("a.bad.com", True)] * 200 + [("b.bad.com", None)] + [("c.good.com", False)] * 200 + [("d.good.com", True)] + [("e.new.com", None)] + [("f.bad.com", False)] * 300
    got = {r["host"]: r for r in hosts.reputations(spark.createDataFrame(outcomes, "host string, bad boolean"), HostConfig()).collect()}
    assert got["a.bad.com"]["blocked"] and not got["c.good.com"]["blocked"] and not got["f.bad.com"]["blocked"]
    assert got["c.good.com"]["rate"] < got["d.good.com"]["rate"] and got["f.bad.com"]["rate"] < got["b.bad.com"]["rate"] < got["a.bad.com"]["rate"]
    assert not got["d.good.com"]["blocked"]  # one page does not outweigh the prior


def test_levels(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("b.com",), ("com",), ("",), ("x.y.b.com",), ("a.b.com.br",), ("www.x.gov.uk",), ("b.co.info",)], "h string")
    cfg = HostConfig()
    got = {r["h"]: (r["d"], r["s"]) for r in rows.select("h", hosts.domain_of(F.col("h"), cfg).alias("d"), hosts.suffix_of(F.col("h"), cfg).alias("s")).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.com": ("b.com", "com"), "com": ("com", "com"), "": ("", ""), "x.y.b.com": ("b.com", "com"), "a.b.com.br": ("b.com.br", "com.br"), "www.x.gov.uk": ("x.gov.uk", "gov.uk"), "b.co.info": ("co.info", "info")}


def test_no_pages_and_no_labels(spark):
    assert hosts.judged(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0
    (row,) = hosts.judged(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), URL_RULES).collect()
    assert row["site"]["verdict"] == "allow"
