"""Recall and exact ranks of the neighbour search, equal vectors, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from panelfold.llm import neighbours
from panelfold.llm.queries import QUERIES


def exact(ids, vectors, query, k=20):
    out = {}
    for i in np.flatnonzero(query(ids)):
        scores = vectors @ vectors[i]
        scores[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -scores))[:k]
        out[int(ids[i])] = [(int(ids[j]), scores[j]) for j in order if scores[j] > -np.inf]
    return out


def test_recall_and_scores_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    place = {int(i): k for k, i in enumerate(ids)}
    wanted = exact(ids, vectors, lambda i: i % 20 == 0)
    found = {}
    for r in QUERIES["op2_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r)
    assert found.keys() == wanted.keys()
    hits = 0
    for q, rs in found.items():
        assert [r["rank"] for r in rs] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        for r in rs:
            assert abs(r["score"] - vectors[place[q]] @ vectors[place[r["vec_id"]]]) < 1e-12
        hits += len({r["vec_id"] for r in rs} & {v for v, _ in wanted[q]})
    assert hits >= 0.9 * 20 * len(wanted)


def test_blocks_of_leaves_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(2)
    ids, vectors = np.arange(300), np.round(rng.normal(size=(300, 6)), 2)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(table, lambda c: c % 3 == 0, k=5, leaves=4, recall=1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    wanted = exact(ids, vectors, lambda i: i % 3 == 0, 5)
    same = sum(len(set(found[q]) & {v for v, _ in w}) for q, w in wanted.items())
    assert same >= 0.98 * 5 * len(wanted)


def test_equal_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 200)]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(200, 260)]
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    odd = [(500, None), (520, [0.0, 0.0, 0.0]), (540, [1.0, None, 0.0]), (560, [float("nan"), 0.0, 1.0]),
           (580, [float("inf"), 0.0, 1.0]), (600, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (40, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    found = {}
    for r in neighbours.nearest(table, lambda c: c % 20 == 0, leaves=1).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    wanted = exact(ids, vectors, lambda i: i % 20 == 0)
    assert {q: [(v, round(float(s), 9)) for v, s in w] for q, w in wanted.items()} == found
    few = table.where("vec_id < 3")
    assert neighbours.nearest(few, lambda c: c % 20 == 0).collect() == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert neighbours.nearest(table.limit(0), lambda c: c % 20 == 0).count() == 0
    assert neighbours.nearest(table.where("vec_id = 1"), lambda c: c % 20 == 0).count() == 0
