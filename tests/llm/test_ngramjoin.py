"""The n-gram join against all pairs; bounds against true differences; no quadratic pairs."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfold.llm import copies, ngramjoin
from panelfold.llm.queries import QUERIES


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[k:] for k in range(width))))


def brute(rows, percent=80):
    """(doc_id, n, component) of every row, in order."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = defaultdict(int)
    for group in holders.values():
        for pair in combinations(group, 2):
            shared[pair] += 1
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            parent[find(j)] = find(i)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [(name, len(sets[i]), least.get(find(i)) if sets[i] else name) for i, (name, _) in enumerate(rows)]


def run(spark, rows, **columns):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(columns)
    found = ngramjoin.join_documents(docs).select("doc_id", "n_shingles", "component_id")
    return sorted(map(tuple, found.collect()), key=repr)


def edited(rng, words, share):
    words = list(words)
    for k in np.flatnonzero(rng.random(len(words)) < share):
        words[k] = f"x{rng.integers(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
            .select("doc_id", "text").collect()]
    found = QUERIES["op13_ngramjoin"](spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows))


def test_odd_rows_against_all_pairs(spark, monkeypatch):
    # Small bounds, so that shingles are common, units and lists are cut, hubs are split.
    for module, name, value in ((ngramjoin, "COMMON", 3), (ngramjoin, "UNIT_SETS", 2), (ngramjoin, "TILE_ROWS", 4),
                                (copies, "PARTNERS", 3), (copies, "HELD", 5), (copies, "WORK", 50)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(11)
    texts = ["", " \n", None, "one", "One", "one two", "a b c d", "A b\tc  d", "a b c d e", "a b c d e", "\x00 b c d e f"]
    for length in (8, 30, 60, 200):
        base = [f"w{k}" for k in rng.integers(0, 10**6, length)]
        texts += [" ".join(base)] * 2 + [edited(rng, base, share) for share in (0.01, 0.02, 0.03, 0.05) for _ in range(5)]
        for _ in range(6):  # insertions and cuts
            cut = int(rng.integers(0, length // 8 + 1))
            texts.append(" ".join(base[cut:] + base[:cut // 2]))
    common = " ".join(f"c{k}" for k in range(40))
    texts += [common + " " + " ".join(f"o{rng.integers(10**9)}" for _ in range(m)) for m in (5, 5, 6, 40, 40) for _ in range(4)]
    texts += ["loop " * 50, "loop " * 60, "LOOP " * 50]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "one"), (None, "one"), (None, "only here and nowhere else at all"),
                                                   (None, None), (7, "quite another text under an id twice used")]
    rows += [(500, texts[40])] * 4
    found = run(spark, rows, set=F.lit("s"), n=F.lit(1), token=F.lit(1), label=F.lit("l"))
    assert found == sorted(brute(rows), key=repr)
    assert run(spark, [(None, None)]) == [(None, 0, None)]
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngramjoin.join_documents(docs).count() == 0


def test_texts_of_one_wording_below_the_threshold_send_few_pairs(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, edited(rng, base, 0.03)) for k in range(1500)]
    true = sum(100 * len(a & b) >= 80 * len(a | b)
               for a, b in combinations([shingles(t) for _, t in rows[:60]], 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row_key", F.xxhash64("doc_id", "text"))
    rows_ = docs.select("doc_id", "row_key", "text")
    may, common = ngramjoin.open_sets(ngramjoin.prints(rows_, 5), rows_, 5, 80)
    nodes = ngramjoin._nodes(rows_, may, copies.BitFilter(common), 5, 80)
    labels = nodes.select("set", F.col("set").alias("label"))
    sent = ngramjoin.open_pairs(nodes, labels, False, 80).count()
    assert nodes.count() > 1000 and true < 60  # all look alike, hardly any are near
    assert sent < 5 * 1500


def test_parity_maps_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for size in (1, 3, 40, 700, 9000):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        sets = [np.unique(np.r_[base[rng.random(size) > share], rng.integers(0, 2**63, int(size * share)).astype(np.uint64)])
                for share in (0, 0.01, 0.1, 0.2, 0.25)]
        maps = copies.ParityMaps([copies.parity(s) for s in sets])
        a, b = np.array(list(combinations(range(len(sets)), 2))).T
        truth = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
        assert (maps.differ(a, b) <= truth).all()


def test_open_sets_keep_every_near_pair():
    for n in range(1, 300):
        assert ngramjoin.needed(n, 80) == -(-4 * n // 5)
        assert ngramjoin.looked_at(n, 80) > n - ngramjoin.needed(n, 80) or n == 0
    codes, ends = ngramjoin.shingle_sets([b"", b"a", b"A", b"a b c d e f", b"a b c d e f" * 2])
    assert np.diff(ends).tolist() == [0, 1, 1, 2, 7] and codes[0] == codes[1]


def test_shingles_travel_as_a_few_bytes(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**9, 400)) for _ in range(3000)]
    texts += texts[:1500]  # copies count once
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(4)
    rows = docs.withColumn("row_key", F.xxhash64("doc_id", "text")).select("doc_id", "row_key", "text").cache()
    firsts = rows.where("doc_id < 3000").select(F.col("row_key").alias("hash"))
    sent = ngramjoin._slices(rows, copies.BitFilter(firsts), 5, 80, 28, 2)
    size = sent.agg(F.sum(F.expr("length(high) + length(low) + length(owner)"))).first()[0]
    shingles_sent = 3000 * ngramjoin.looked_at(396, 80)
    assert size < 6 * shingles_sent and sent.count() <= 4 * 5
    may, _ = ngramjoin.open_sets(ngramjoin.prints(rows, 5), rows, 5, 80)
    assert may.count() < 150  # nothing is shared but by the filter's mistakes
    rows.unpersist()


def test_a_shingle_of_all_rows_is_sent_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "COMMON", 20)
    docs = spark.createDataFrame([(k, "a b c d e") for k in range(4000)], "doc_id bigint, text string").coalesce(2)
    rows = docs.withColumn("row_key", F.xxhash64("doc_id", "text")).select("doc_id", "row_key", "text")
    sent = ngramjoin._slices(rows, copies.BitFilter(rows.select(F.col("row_key").alias("hash"))), 5, 80, 28, 0)
    assert sent.agg(F.sum(F.length("low") / 2)).first()[0] <= 2 * 21
    hot = ngramjoin._told(sent, 28, 0).where("hash is not null").count()
    assert hot == 1
