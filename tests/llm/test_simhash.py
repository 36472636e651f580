"""SimHash groups against brute force, dense groups, chains and odd rows."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelfold.llm import simhash
from panelfold.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def brute_groups(codes, ids):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    smallest = {}
    for i in range(len(codes)):
        smallest[find(i)] = min(smallest.get(find(i), ids[i]), ids[i])
    return [smallest[find(i)] for i in range(len(codes))]


def near_codes():
    rng = np.random.default_rng(5)
    far = rng.integers(0, 1 << 63, 200, np.uint64) * np.uint64(2)
    centre = rng.integers(0, 1 << 63, 1, np.uint64)[0]
    flips = np.uint64(1) << rng.integers(0, 64, (300, 2)).astype(np.uint64)
    dense = centre ^ flips[:, 0] ^ flips[:, 1]
    chain = [far[0]]
    for k in range(60):
        chain.append(chain[-1] ^ (np.uint64(7) << np.uint64(k)))
    pairs = far[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    return np.unique(np.concatenate([far, dense, np.array(chain, np.uint64), pairs]))


@pytest.mark.parametrize("groups", [1, 3])
def test_index_connects_what_brute_force_connects(groups):
    codes = near_codes()
    owner = np.sort(np.arange(len(codes)) % groups)
    u, v = simhash.local_stars(owner, codes, work=1 << 12)
    for g in range(groups):
        own = np.flatnonzero(owner == g)
        expected = brute_groups(codes[own], own.tolist())
        label = {int(i): int(i) for i in own}
        for a, b in zip(u.tolist(), v.tolist()):
            if owner[a] == g:
                assert owner[b] == g
                label[a] = b
        seen = {}
        for i, e in zip(own.tolist(), expected):
            assert seen.setdefault(label[i], e) == e
        assert len(seen) == len(set(expected))


def test_routing_loses_no_link_when_keys_are_crowded(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 20)
    codes = near_codes()
    rows = [(int(c.view(np.int64)), i) for i, c in enumerate(codes)]
    nodes = spark.createDataFrame(rows, "simhash bigint, rep bigint")
    found = dict(components(simhash.links(nodes)).collect())
    expected = brute_groups(codes, list(range(len(codes))))
    assert [found.get(i, i) for i in range(len(codes))] == expected


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    links = spark.createDataFrame(chain + hub + [(5, 5), (None, 7)], "u bigint, v bigint")
    found = dict(components(links).collect())
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(links.where("false")).count() == 0


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "One two THREE four"), (3, "one  two\nthree four"), (9, None), (8, ""), (7, " \t\n"),
            (None, "one two three four"), (3, "one  two\nthree four"), (4, "alone"), (2, long),
            (6, long + " tail"), (None, "nobody has my id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn(
        "simhash", F.lit("clash")).withColumn("_digest", F.lit(1)).withColumn("a.b", F.lit(2))
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row["simhash"] % (1 << 64) in {brute_print(t) for i, t in rows if i == row["doc_id"]}
    groups = {(r["doc_id"], r["component_id"]) for r in found}
    assert groups == {(5, 3), (3, 3), (9, 7), (8, 7), (7, 7), (None, 3), (4, 4), (2, 2), (6, 2), (None, None)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [
        (False, 2), (False, 3), (False, 4), (False, 7), (True, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from panelfold.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    codes = np.array([brute_print(t) for _, t in rows], np.uint64)
    expected = sorted(zip([i for i, _ in rows], [f"{int(c):016x}" for c in codes],
                          brute_groups(codes, [i for i, _ in rows])))
    assert sorted(map(tuple, QUERIES["op1_simhash"](spark, sf).collect())) == expected


def brute_sets(texts):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def jaccard(x, y):
    return 1.0 if x == y else len(x & y) / len(x | y)


def test_keep_one_finds_near_copies_with_changed_words(spark):
    rng = np.random.default_rng(3)
    rows, pairs = [], 0
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(40, 400))]
        rows.append((1000 + 2 * k, " ".join(words)))
        copy = list(words)
        for place in rng.choice(len(words), 1 + int(rng.random() * len(words) / 35), replace=False):
            copy[place] = f"x{rng.integers(0, 5000)}"
        rows.append((1001 + 2 * k, " ".join(copy)))
    sets = brute_sets([t for _, t in rows])
    near = {rows[i + 1][0] for i in range(0, len(rows), 2) if jaccard(sets[i], sets[i + 1]) >= 0.8}
    kept = {r["doc_id"] for r in simhash.keep_one(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    gone = {i for i, _ in rows} - kept
    assert 100 < len(near) < 250
    assert gone <= near  # no text goes without a copy that stays
    assert len(gone) >= 0.97 * len(near)


def test_keep_one_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    sets = brute_sets([t for _, t in rows])
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [rows[i][0] for i in sorted(set(root))]
