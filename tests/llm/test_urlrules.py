"""Listed rules against plain code, mined rules against counting, odd URLs."""

import re

from pyspark.sql import functions as F

from panelfold.llm import urlrules
from panelfold.llm.queries import QUERIES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut])
    rest = rest[cut:]
    return host, rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def listed(host, path, rules=urlrules.RULES):
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
            and path.startswith(r[len(r.split("/")[0]):])]
    return max(fits, key=len, default=None)


def test_query_against_plain_code(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    found = QUERIES["op4_urls"](spark, sf).collect()
    assert len(found) == len(pages)
    expected = {i: (*split(u), listed(*split(u))) for i, u in pages}
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in found} == expected
    assert all(r["verdict"] == urlrules.RULES[r["rule"]] for r in found if r["rule"])
    assert {r["verdict"] for r in found} <= {"allow", "block"}


def test_odd_urls(spark):
    urls = [None, "", "no scheme.net/", "http://", "http://NET/", "http://a.net", "http://a.net?x=/", "x://Ä.Net/ß?q#f",
            "ftp://example.net/en/x", "http://sub.EXAMPLE.net/en/", "http://notexample.net/en/", "http://example.com/de",
            "http://example.com/de/1", "http://a.org/fr/", "http://org/fr/x#y?z", "http://h/a\nb?c", "http://a://b.net/", "://net/",
            "http://a.net/", "http://a.net/", "http://" + "a." * 4000 + "net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://x.net/"), (1, "http://y.net/")],
                                  "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    none = spark.createDataFrame([], "url string, bad int")
    found = urlrules.judge(pages, none).collect()
    expected = [(r["page_id"], *split(r["url"]), listed(*split(r["url"]))) for r in pages.collect()]
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"]) for r in found))) == sorted(map(str, expected))
    assert {r["verdict"] for r in found if r["rule"] is None} == {"allow"}
    assert urlrules.judge(pages.limit(0), none).count() == 0


def test_mined_rules_block_what_labels_show(spark):
    good = [(f"http://www.fine{i % 7}.test/en/{i}.html", 0) for i in range(300)]
    bad = [(f"http://spam.test/en/{i}?ref=x", 1) for i in range(60)]
    mixed = [(f"http://spam.test/en/{i}", i % 2) for i in range(40)]
    labelled = spark.createDataFrame([*good, *bad, *mixed, (None, 1), ("http://spam.test/", None)], "url string, bad int")
    rules = urlrules.mine(labelled, support=0.01, confidence=0.8)
    rows = rules.collect()
    assert any(r["verdict"] == "block" and "query:ref" in r["items"] for r in rows)
    table = labelled.where("bad is not null").select(urlrules.tokens().alias("t"), "bad").collect()
    for r in rows:
        hit = [x["bad"] for x in table if set(r["items"]) <= set(x["t"])]
        want = sum(hit) if r["verdict"] == "block" else len(hit) - sum(hit)
        assert abs(want / len(hit) - r["confidence"]) < 1e-9 and r["confidence"] >= 0.8
        assert not any(set(o["items"]) < set(r["items"]) and o["verdict"] == r["verdict"]
                       and len(o["items"]) == len(r["items"]) - 1 and o["confidence"] >= r["confidence"] for o in rows)
    pages = spark.createDataFrame([(1, "http://spam.test/en/9999?ref=y"), (2, "http://www.fine3.test/en/7.html"),
                                   (3, "http://other.test/"), (4, "http://example.net/en/?ref=x")],
                                  "page_id bigint, url string")
    found = {r["page_id"]: r for r in urlrules.judge(pages, labelled, support=0.01, confidence=0.8).collect()}
    assert [found[i]["verdict"] for i in (1, 2, 3, 4)] == ["block", "allow", "allow", "allow"]
    assert found[1]["mined_rule"] and found[4]["rule"] == "example.net/en/"
