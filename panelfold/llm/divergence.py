"""How far the sources of a language drift apart in their words, in whole numbers."""

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelfold.llm.textscan import as_bytes, pieces
from panelfold.session import materialize

LEAST_DOCS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
# Entries that a task holds before it sends them on, terms of a block, sources of a tile.
HELD, BLOCK_TERMS, TILE_SOURCES = 1 << 17, 1 << 15, 8
TEXT_BLOCK = 1 << 20

# A term is a run of letters A-Z, a-z and bytes of non-ASCII signs; only A-Z are folded.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def text_terms(text: bytes, block: int = TEXT_BLOCK):
    """Lists of a text's terms; a long text comes in blocks cut between terms."""
    start = 0
    while start < len(text):
        part = text[start:start + block].translate(_FOLD)
        if start + block < len(text):
            cut = part.rfind(b" ") + 1
            if not cut:  # one term longer than a block
                block *= 2
                continue
            part = part[:cut]
        start += len(part)
        yield part.split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term (UTF-8 bytes), n, docs``: occurrences and documents of every term
    of a group; null text, lang and source count as ''."""
    source = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                           for c in ("lang", "source", "text")])

    def sent(held):
        for (lang, source), (counts, seen) in held.items():
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                 pa.array(list(counts), pa.binary()),
                 pa.array(list(counts.values()), pa.int64()),
                 pa.array([seen[t] for t in counts], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        held = defaultdict(lambda: (Counter(), Counter()))
        for batch in pieces(batches):
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, as_bytes(batch.column(2))):
                counts, seen = held[lang, source]
                own = set()
                for terms in text_terms(text):
                    counts.update(terms)
                    own.update(terms)
                seen.update(own)
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield from sent(held)
                held.clear()
        yield from sent(held)

    found = source.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exactly."""
    return F.expr(f"1 + cast({SCALE} as decimal(20,0)) * ({n} + 2) div ({total} + 2 * {kept})")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so squares fit in 64 bits."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def shares(counts: np.ndarray, divisor: int) -> np.ndarray:
    """``share`` in numpy: long division by thousands keeps every step in 64 bits
    for divisors below 9 * 10^15."""
    out, rest = np.zeros(len(counts), np.int64), counts + 2
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // divisor, rest * 1000 % divisor
    return out + 1


def gaps(p, q):
    return (p - q) ** 2 // (p + q)


def _merged(a, b, absent: int) -> int:
    """Sum of gaps over a block: ``a`` and ``b`` are (sorted ids, shares, share of an absent
    term); terms of both, of one, and ``absent`` ones of neither side."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids, p, p0), (others, q, q0) = a, b
    # The short array gallops through the long one.
    at = np.searchsorted(others, ids)
    both = at < len(others)
    both[both] = others[at[both]] == ids[both]
    at = at[both]
    alone = np.ones(len(q), bool)
    alone[at] = False
    return (int(gaps(p[both], q[at]).sum()) + int(gaps(p[~both], q0).sum())
            + int(gaps(p0, q[alone]).sum())
            + (absent - len(ids) - len(others) + len(at)) * int(gaps(p0, q0)))


def pair_sums(arrays: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for every unordered pair of sources, a before b.

    ``arrays`` has lang, source, tile, tiles, block, block_terms, divisor, ids, counts. A task meets two
    tiles of sources in one block of term ids, so its size is bounded; an array travels
    once per tile, not once per partner. Blocks are summed by Spark.
    """
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    dealt = (arrays.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumns({"low": low, "high": high}))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source")
        first = rows.iloc[0]
        held = [(r.source, r.tile, (np.asarray(r.ids, np.int64), shares(np.asarray(r.counts, np.int64), r.divisor),
                                    int(shares(np.zeros(1, np.int64), r.divisor)[0])))
                for r in rows.itertuples()]
        out = [(first.lang, a, b, _merged(x, y, int(first.block_terms)))
               for i, (a, s, x) in enumerate(held) for b, t, y in held[i + 1:]
               if {s, t} == {first.low, first.high}]
        return pd.DataFrame(out, columns=["lang", "a", "b", "value"])

    return (dealt.groupBy("lang", "block", "low", "high")
            .applyInPandas(run, "lang string, a string, b string, value bigint")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs from the others.

    Part ``pair``: every other source of the language by the sum of gaps over all kept
    terms. Part ``term``: the ``top`` terms that the source uses more than its language
    does. A language keeps the terms that occur in at least ``least_docs`` of its
    documents. Null text, lang and source count as ''; a group without terms still
    takes part; repeated rows count each; ties go by the item's UTF-8 bytes. An empty
    table gives no rows. Other columns aren't read.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                           for c in ("lang", "source")]).distinct()
    counts = materialize(term_counts(docs), "terms")
    kept = materialize(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs).drop("docs"), "kept_terms")
    # Ids of a written table: its part number above, the row's place in the part below.
    kept = materialize(
        kept.withColumn("id", F.monotonically_increasing_id())
        .withColumn("block", F.shiftright("id", int(np.log2(BLOCK_TERMS)))), "term_ids")
    listed = materialize(counts.join(kept, ["lang", "term"])
                         .select("lang", "source", "term", "n", "lang_n", "id", "block"), "listed")

    langs = (groups.groupBy("lang").agg(F.count("*").alias("sources"))
             .join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")),
                   "lang", "left")
             .select("lang", F.coalesce("kept", F.lit(0)).alias("kept"),
                     F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
                     F.ceil(F.col("sources") / TILE_SOURCES).cast("int").alias("tiles")))
    totals = listed.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = materialize(
        groups.join(langs, "lang").join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept", "lang_total", "tiles",
                F.pmod(F.xxhash64("source"), F.col("tiles").cast("bigint")).cast("int").alias("tile")), "groups")

    blocks = kept.groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    entry = F.struct("id", "n")
    runs = (listed.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(entry)).alias("e"))
            .select("lang", "source", "block", F.col("e.id").alias("ids"), F.col("e.n").alias("counts")))
    none = F.array().cast("array<bigint>")
    arrays = (sizes.join(blocks, "lang").join(runs, ["lang", "source", "block"], "left")
              .select("lang", "source", "tile", "tiles", "block", "block_terms",
                      (F.col("total") + 2 * F.col("kept")).alias("divisor"),
                      F.coalesce("ids", none).alias("ids"), F.coalesce("counts", none).alias("counts")))
    sums = pair_sums(arrays)
    one = sizes.select("lang", F.col("source").alias("a"))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    # Languages without kept terms: every pair differs by nothing.
    bare = sizes.where("kept = 0").select("lang", "source")
    both = both.unionAll(bare.join(one, "lang").where("source <> a")
                         .select("lang", "source", F.col("a").alias("item"), F.lit(0).cast("bigint").alias("value")))
    terms = (listed.join(sizes, ["lang", "source"])
             .withColumns({"p": share("n", "total", "kept"), "q": share("lang_n", "lang_total", "kept")})
             .where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"),
                                    gap("p", "q").alias("value")))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [frame.withColumn("rank", place).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
             for part, frame in (("pair", both), ("term", terms))]
    return parts[0].unionAll(parts[1].where(F.col("rank") <= top))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
      FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.total + 2 * v.v))::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (k.lang_n + 2) // (v.total + 2 * v.v))::HUGEINT AS q
  FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""
