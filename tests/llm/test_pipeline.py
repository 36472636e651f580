"""The pipeline, stage by stage, against brute force on a small table."""

from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from panelfold.llm import mixing, passages
from tests.llm import test_containment, test_ngramjoin, test_tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        frames.append([r.asDict() for r in docs.collect()])
    whole = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    # The classifier's own model on every text by itself.
    model = passages.train(spark.read.parquet(f"{SF}/documents.parquet"), labels, "quality")
    good = []
    for r in whole:
        x, row = passages.passage_features([r["text"].encode()])
        if model.score(x, row, 1)[0] >= 0.7:
            good.append(r)
    assert Counter(r["doc_id"] for r in frames[0]) == Counter(r["doc_id"] for r in good)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"] for r in good}
    judged = [quality[r["doc_id"]] == (r["doc_id"] in kept) for r in whole if r["doc_id"] in quality]
    assert np.mean(judged) > 0.95

    groups = test_ngramjoin.brute([(r["doc_id"], r["text"]) for r in frames[0]])
    assert sorted(r["doc_id"] for r in frames[1]) == sorted({least for _, n, least in groups if n}
                                                            | set([min(i for i, n, _ in groups if not n)] if any(
                                                                not n for _, n, _ in groups) else []))

    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    bad = {d for d, *_ in test_containment.brute([(r["doc_id"], r["text"]) for r in frames[1]], items)}
    assert sorted(r["doc_id"] for r in frames[2]) == sorted(r["doc_id"] for r in frames[1] if r["doc_id"] not in bad)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    copies = {d: taken // size for d, size, _, _, taken in con.execute(mixing.SQL).fetchall() if size}
    assert Counter(r["doc_id"] for r in frames[3]) == Counter({d: n for d, n in copies.items() if n})
    texts = {r["doc_id"]: r for r in whole}
    assert all(r == texts[r["doc_id"]] for r in frames[3])

    rows = sorted((r["doc_id"], r["text"]) for r in frames[3])
    assert sorted(tuple(r.values()) for r in frames[4]) == test_tokens.brute(rows)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == test_tokens.brute(rows)
