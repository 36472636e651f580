"""Phrases against their SQL and against plain Python; the trie against counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfold.llm import phrases
from panelfold.llm.queries import QUERIES, SQL
from tests.compare import compare

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top=2000, longest=5):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(FOLD)):
            words = re.findall("[^\\x20\\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], []
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer.get(p[i:j], 0), a)
        for p, a in often.items():
            if longer.get(p, 0) < a:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -score)
                for i, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    assert compare(spark, "op12_phrases", QUERIES["op12_phrases"], SQL["op12_phrases"], f"/root/testdata/{sf}") is None


def test_odd_rows_against_brute_force(spark, monkeypatch):
    # Small parts, so that keys, candidates and passes are cut.
    for name, value in (("KEYS", 7), ("CANDIDATES", 40), ("AT_ONCE", 2), ("HELD", 50), ("PAIRS", 60), ("PHRASES", 70)):
        monkeypatch.setattr(phrases, name, value)
    rng = np.random.default_rng(5)
    words = ["A", "a", "\x00", "b\x00", "Ü", "ü", "don't", "日本", "x" * 300, "\x1c", "l"]
    signs = [" ", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r", "\x0b", "?!"]
    rows = [("".join(x for w in rng.choice(words, rng.integers(0, 60)) for x in (w, str(rng.choice(signs)))),
             [None, "und", "de", ""][k % 4]) for k in range(200)]
    rows += [(None, "de"), ("", None), (" . ", "fr"), ("one two three", "it")] + [("q r s t u v w", "nl")] * 9
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns(
        {"phrase": F.lit(1), "n": F.lit("n"), "word": F.lit(0), "doc_id": F.lit(1)})
    found = phrases.collocations(docs, least=9, top=300)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 9, 300)
    assert [r["phrase"] for r in found.where("lang = 'nl'").orderBy("rank").collect()] \
        == ["q r s t u", "r s t u v", "s t u v w"]
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_trie_counts_as_a_scan_does():
    rng = np.random.default_rng(2)
    for words, number, length in ((3, 200, 5), (50, 3000, 4), (1000, 3000, 2), (1, 5, 5)):
        chosen = {tuple(rng.integers(1, words + 1, rng.integers(2, length + 1))) for _ in range(number)}
        text = rng.integers(1, words + 2, 5000).astype(np.uint64)
        joins = rng.random(5000) < 0.8
        joins[-1] = False
        expected = Counter()
        for k in range(2, length + 1):
            for i in range(5000 - k + 1):
                if joins[i:i + k - 1].all():
                    expected[tuple(text[i:i + k].tolist())] += 1
        chosen = sorted(chosen)
        trie = phrases.Trie.load(phrases.Trie([np.array(p, np.uint64) for p in chosen]).dump())
        found = trie.count(text, joins, np.arange(5000))
        assert found.tolist() == [expected[tuple(map(int, p))] for p in chosen]
    assert phrases.Trie([]).count(text, joins, np.arange(5000)).tolist() == []


def test_a_phrase_is_sent_by_few_tasks_not_by_all(spark):
    rng = np.random.default_rng(9)
    wording = [" ".join(f"w{k}" for k in rng.integers(0, 400, 5)) for _ in range(300)]
    rows = [(" ".join(rng.permutation(wording)[:40]) + f" x{k}", "en") for k in range(1600)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(16).cache()
    words = phrases.word_counts(docs)
    bounds = phrases.bounds(docs, words.where("n >= 100"), words.agg(F.sum("n")).first()[0], 100)
    sent = phrases.sent_phrases(docs, *bounds, 5, 100)
    distinct = sent.distinct().count()
    assert distinct > 1000 and sent.count() < 1.2 * distinct
    docs.unpersist()


def test_counts_of_a_trie_are_sent_in_slices(spark, monkeypatch):
    monkeypatch.setattr(phrases, "COUNTS", 7)  # so that a trie's counts are cut
    rows = [("a b c, d e f, g h i, j k l, m n o, p q r", "en")] * 120
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    found = phrases.collocations(docs).collect()
    assert {(r["phrase"], r["a"]) for r in found} == {(p, 120) for p in
                                                    ("a b c", "d e f", "g h i", "j k l", "m n o", "p q r")}
