"""The mix against its SQL, targets, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfold.llm import mixing
from panelfold.llm.queries import QUERIES, SQL
from tests.compare import compare


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    assert compare(spark, "op8_mix", QUERIES["op8_mix"], SQL["op8_mix"], f"/root/testdata/{sf}") is None


def test_sources_come_near_their_targets(spark):
    found = QUERIES["op8_mix"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    rows = (found.join(docs, "doc_id").groupBy("source")
            .agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"),
                 F.first("source_size").alias("whole"), F.max(F.col("taken") > 2 * F.col("size")).alias("over"))
            .collect())
    for r in rows:
        assert r["size"] == r["whole"] and not r["over"] and r["target"] <= 2 * r["whole"]
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"]  # whole documents only
    total = sum(r["whole"] for r in rows)
    assert abs(sum(r["target"] for r in rows) - 1.5 * total) < 1e-6 * total


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (2, "a", None), (3, None, "x"), (4, "", "zero"), (None, "d e f g", "y"),
            (5, "one two", "y"), (5, "one two", "y"), (6, "word " * 500, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn(
        "size", F.lit("s")).withColumn("_plan", F.lit(1)).withColumn("draw", F.lit(1))
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    assert {r["source"] for r in found if r["target"] == 0} == {"zero"}
    assert all(r["taken"] <= 2 * r["size"] for r in found)
    again = sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert again == sorted(map(str, found))
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    count = {}
    for r in copies.collect():
        count[r["doc_id"], r["text"]] = count.get((r["doc_id"], r["text"]), 0) + 1
    expected = {}
    texts = {(i, len((t or "").split())): t for i, t, _ in rows}
    for r in found:
        key = (r["doc_id"], texts[r["doc_id"], r["size"]])
        expected[key] = expected.get(key, 0) + r["copies"]
    assert count == {k: n for k, n in expected.items() if n}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_one_long_document_does_not_end_the_sample(spark, tmp_path):
    # A quarter of each source is left to take; the long document mostly doesn't fit.
    rows = [(100 * s + k, " ".join([f"d{s}_{k}"] * (20000 if k == 0 else 200 + k * 37 % 200)), f"s{s:02}")
            for s in range(12) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(docs, weights=(1,), share=0.25).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(found) == 12 and all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in found)


def test_odd_rows_against_sql(spark, tmp_path):
    import duckdb
    rng = np.random.default_rng(6)
    rows = [(int(k) if k % 7 else None, "w " * int(rng.integers(0, 60)), [None, "", "a", "b"][k % 4]) for k in range(300)]
    rows += [(5, "same text " * 4, "a")] * 5 + [(5, "same text " * 4, "b")] + [(9, "x " * 900, "b"), (None, None, "c")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    mine = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, mine), key=key) == sorted(con.execute(mixing.SQL).fetchall(), key=key)
