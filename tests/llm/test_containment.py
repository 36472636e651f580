"""Contained items against brute force, short items, odd rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelfold.llm import containment


def shingles(text):
    words = "".join(c.lower() if c.isascii() and c.isalnum() or "À" <= c <= "Þ" and c != "×"
                    else c if not c.isascii() else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items):
    parts = {i: shingles(t) for i, t in items if i is not None}
    inverted = defaultdict(list)
    for i, s in parts.items():
        for x in s:
            inverted[x].append(i)
    found = set()
    for d, t in docs:
        hits = defaultdict(int)
        for x in shingles(t):
            for i in inverted.get(x, ()):
                hits[i] += 1
        found |= {(d, i, len(parts[i]), n) for i, n in hits.items() if n >= 0.8 * len(parts[i]) - 1e-9}
    return found


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    from panelfold.llm.queries import QUERIES
    sf = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    found = QUERIES["op7_decontaminate"](spark, sf).drop("containment").collect()
    assert {tuple(r) for r in found} == brute(docs, items) and len(found) == len({*found})


def test_every_share_around_the_threshold(spark):
    item = [f"w{i}" for i in range(44)]  # 40 shingles
    docs = [(k, " ".join(["x"] * 50 + item[:44 - k] + ["y"] * 5000)) for k in range(1, 12)]
    found = containment.contained_items(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert {r["doc_id"]: r["shared"] for r in found.collect()} == {k: 40 - k for k in range(1, 9)}
    for n in range(1, 200):
        assert containment.sketch_size(n) > n - -(-8 * n // 10) or containment.sketch_size(n) == n


def test_odd_rows(spark):
    passage = "The Quick, brown fox; jumps over ÉVERY lazy dog again"
    same = "the quick brown fox jumps over évery lazy dog again"
    docs = spark.createDataFrame(
        [(1, f"a b c {same} d"), (None, same), (2, None), (3, ""), (4, "clean words only"), (1, "other text"),
         (5, "tiny item"), (6, "a tiny item in a text"), (7, same), (7, same)],
        "doc_id bigint, text string").withColumn("shared", F.lit(1)).withColumn("_bad", F.lit(2))
    items = spark.createDataFrame([(10, passage), (11, "Tiny item!"), (12, None), (13, ""), (None, passage)],
                                  "item_id bigint, text string")
    found = sorted(map(str, containment.contained_items(docs, items).select("doc_id", "item_id").collect()))
    assert found == sorted(["Row(doc_id=1, item_id=10)", "Row(doc_id=None, item_id=10)",
                            "Row(doc_id=5, item_id=11)", "Row(doc_id=7, item_id=10)"])
    clean = containment.without_items(docs, items)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in clean.collect()) == [
        (1, "other text"), (2, ""), (3, ""), (4, "clean words only"), (6, "a tiny item in a text")]
    assert containment.contained_items(docs.limit(0), items).count() == 0
    assert containment.without_items(docs, items.limit(0)).count() == docs.count()
