"""Source divergence against its SQL and against plain Python."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfold.llm import divergence
from panelfold.llm.queries import QUERIES, SQL
from tests.compare import compare

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, top=10):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(FOLD))
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        shares, q = {s: p(c) for s, c in groups.items()}, p(whole)
        lists = defaultdict(list)
        for a, b in permutations(groups, 2):
            lists[a, "pair"].append((b, sum((shares[a][t] - shares[b][t]) ** 2 // (shares[a][t] + shares[b][t])
                                            for t in kept)))
        for s, c in groups.items():
            lists[s, "term"] = [(t, (shares[s][t] - q[t]) ** 2 // (shares[s][t] + q[t]))
                                for t in kept if c[t] > 0 and shares[s][t] > q[t]]
        for (s, part), items in lists.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, s, part, t, v, k) for k, (t, v) in enumerate(items, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    assert compare(spark, "op11_divergence", QUERIES["op11_divergence"], SQL["op11_divergence"],
                   f"/root/testdata/{sf}") is None


def test_odd_rows_against_brute_force(spark, monkeypatch):
    # Small blocks and tiles, so that pairs meet over many tasks.
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 4)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    rng = np.random.default_rng(3)
    words = ["Ab", "ab", "Zürich", "ÄRGER", "ärger", "x", "日本語", "a1b", "don't"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))), "en", f"s{rng.integers(0, 7)}") for _ in range(150)]
    rows += [("ab ab x", None, None)] * 12 + [("ab", None, ""), (None, "en", "bare"), ("", "en", "s1"),
                                              ("1 2 3 !", "de", "p"), ("Wort", "de", "q"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns(
        {"term": F.lit(1), "block": F.lit("b"), "n": F.lit(2), "doc_id": F.lit(1)})
    found = [tuple(r) for r in divergence.divergence(docs).select(
        "lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    assert {r[4] for r in found if r[0] == "de"} == {0}
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact_for_huge_counts():
    rng = np.random.default_rng(1)
    divisor = 8 * 10**15 + 3
    counts = np.r_[0, 1, divisor - 2, rng.integers(0, divisor - 2, 1000)]
    assert divergence.shares(counts, divisor).tolist() == [1 + 10**9 * (int(c) + 2) // divisor for c in counts]


def test_long_text_in_blocks():
    text = ("Ein Wort " * 50 + "x" * 90 + " ende. " + "ü" * 70).encode()
    for block in (1, 7, 64, 10**6):
        assert [t for part in divergence.text_terms(text, block) for t in part] \
            == [t.encode() for t in TERM.findall(text.decode().translate(FOLD))]
