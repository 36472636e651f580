"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelfold.llm.rows import narrow, widen
from panelfold.session import materialize

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
CUTS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A random number in (0, 1) that depends on the row's id and text alone."""
    key = F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.col(text)))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(2.0 ** 52)


def _ranked(sources: DataFrame) -> DataFrame:
    """Place of each source in code-point order, null last.

    A global sort numbers rows inside its ranges; only one row count per range
    meets in a single task.
    """
    placed = materialize(
        sources.orderBy(F.col("source").isNull(), "source")
        .withColumn("mid", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("mid", 33)
    before = (placed.groupBy(part.alias("part")).count()
              .withColumn("before", F.sum("count").over(
                  Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))))
    return (placed.withColumn("part", part).join(before, "part")
            .withColumn("place", F.coalesce("before", F.lit(0))
                        + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("mid", "part", "before", "count"))


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: ``share`` of all sizes split by
    the repeating weights, no target above ``most`` times its source's size.

    The excess of sources at their limit is shared again by weight; each round sends
    the driver three sums. Only sources can be limited further, so it ends.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    table = materialize(
        _ranked(sources).withColumn("w", F.element_at(cycle, (F.col("place") % len(weights) + 1)
                                                      .cast("int")))
        .withColumn("most", F.lit(most) * F.col("source_size")), "weighted")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, limited = None, -1
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("w") > F.col("most")
        found = table.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)),
                          F.sum(F.when(full, 0).otherwise(F.col("w"))),
                          F.sum(F.when(full, 1).otherwise(0))).first()
        if found[2] == limited or not found[1]:
            break
        limited, level = found[2], (total - found[0]) / found[1]
    level = level or 0.0
    return table.withColumn("target", F.least(F.lit(level) * F.col("w"), F.col("most"))).drop("w", "most")


def _odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def _order(draw: Column, doc_id: Column, size: Column, chance: Column) -> Column:
    """Place in a source's ranking: random odds over inclusion odds, then id and size."""
    return F.struct((_odds(draw) / _odds(chance)).alias("odds"), draw.alias("draw"), doc_id.alias("doc_id"),
                    size.alias("size"))


def units(sized: DataFrame) -> DataFrame:
    """Rows that are taken together (one id, text and source): ``words`` of them all."""
    return sized.groupBy("source", "draw", "doc_id", "size").agg((F.col("size") * F.count("*")).alias("words"))


def _edge(rows: DataFrame, room: DataFrame, cut: Column) -> DataFrame:
    """Per source the slice of the ranking in which the words run out: ``s, edge, before``.

    ``rows`` has s, words and what ``cut`` needs; ``room`` has s and left. Sources
    whose rows all fit have no such slice.
    """
    sums = rows.groupBy("s", cut.alias("edge")).agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("edge"))
    return (sums.withColumn("upto", upto).join(room.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")))
            .where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
            .select("s", "edge", (F.col("upto") - F.col("words")).alias("before")))


def _walk(rows: DataFrame, room: DataFrame) -> DataFrame:
    """How far down the ranking ``rows`` (s, draw, doc_id, size, words) fit into ``room``
    (s, left, chance): ``s, limit, last, left``.

    ``last`` is the place of the last row that fits before the first that doesn't; it is null
    where all rows fit. Word sums over slices of the draw, cut twice, lead to the
    few rows that are sorted in one task.
    """
    by = lambda frame, name: frame.withColumnRenamed("s", name)
    same = lambda name: F.col("s").eqNullSafe(F.col(name))
    coarse, fine = F.floor(F.col("draw") * CUTS), F.floor(F.col("draw") * (CUTS * CUTS))
    all_words = rows.groupBy("s").agg(F.sum("words").alias("words"))
    outer = materialize(_edge(rows, room, coarse), "coarse_edges")
    part = rows.join(by(outer, "o"), same("o") & (coarse == F.col("edge"))).drop("o", "edge", "before")
    left = (room.join(by(outer, "o"), same("o")).select("s", (F.col("left") - F.col("before")).alias("left"),
                                                          F.col("left").alias("limit"), "chance"))
    inner = materialize(_edge(part, left, fine).join(by(left, "o"), same("o"))
                        .select("s", "edge", (F.col("left") - F.col("before")).alias("left"), "limit", "chance"),
                        "fine_edges")
    order = _order(F.col("draw"), F.col("doc_id"), F.col("size"), F.col("chance"))
    here = part.join(by(inner, "o"), same("o") & (fine == F.col("edge"))).withColumn("order", order)
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("order"))
    fits = (here.withColumn("upto", upto).where(F.col("upto") <= F.col("left"))
            .groupBy("s").agg(F.max("order").alias("last"), F.max("upto").alias("words")))
    none = _order(F.col("edge") / F.lit(float(CUTS * CUTS)), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"),
                  F.col("chance"))
    stopped = (inner.join(by(fits, "o"), same("o"), "left")
               .select("s", F.col("limit"), F.coalesce("last", none).alias("last"),
                       (F.col("left") - F.coalesce("words", F.lit(0))).alias("left")))
    through = (all_words.join(by(room, "o"), same("o")).where(F.col("words") <= F.col("left"))
               .select("s", F.col("left").alias("limit"), F.lit(None).cast(stopped.schema["last"].dataType).alias("last"),
                       (F.col("left") - F.col("words")).alias("left")))
    return stopped.unionAll(through)


def plan(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per source: whole copies of every document, and which are sampled.

    ``sized`` has source, size, doc_id and draw. A source's documents are to be
    taken ``target / source_size`` times: the whole part is certain, the rest is the
    inclusion probability of a Pareto order sample (rank by odds of the draw over
    inclusion odds). The sample goes down the ranking and takes every document whose words
    still fit in what is left; ``walks`` says how far each walk came and what fitted
    into it. Each walk ends at a document that doesn't fit, the next one goes on
    behind it, until none fits. Then the one document of the rest that closes the
    gap best is added, if it brings the sum nearer.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    split = materialize(
        targets(sources, weights, share, most)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                    .otherwise(0.0))
        .withColumn("whole", F.floor("rate"))
        .withColumn("chance", F.col("rate") - F.col("whole"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "chance", "left"), "split")
    named = split.withColumnRenamed("source", "s")
    room = named.where("chance > 0").select("s", "left", "chance")
    rows = materialize(units(sized).where("words > 0").withColumnRenamed("source", "s"), "units")
    rest, walks, gaps = rows, [], room
    while True:
        found = materialize(_walk(rest, room).withColumn("walk", F.lit(len(walks))), "walk")
        if found.isEmpty():
            break
        walks.append(found.select("s", "walk", "limit", "last"))
        after = found.select(F.col("s").alias("o"), F.col("left").alias("now"), "last")
        same = F.col("s").eqNullSafe(F.col("o"))
        gaps = materialize(gaps.join(after, same, "left")
                           .select("s", F.coalesce("now", "left").alias("left"), "chance"), "gaps")
        behind = after.where("last is not null")
        room = materialize(gaps.join(behind.select("o"), same, "left_semi"), "room")
        order = _order(F.col("draw"), F.col("doc_id"), F.col("size"), F.col("chance"))
        rest = materialize(
            rest.join(behind.join(room.withColumnRenamed("s", "p").drop("left"), F.col("o").eqNullSafe(F.col("p"))),
                      same)
            .where((F.col("words") <= F.col("now")) & (order > F.col("last"))).select(*rows.columns), "rest")
    if walks:
        steps = (reduce(DataFrame.unionAll, walks).groupBy("s")
                 .agg(F.sort_array(F.collect_list(F.struct("walk", "limit", "last"))).alias("walks")))
        steps = materialize(steps.withColumnRenamed("s", "o"), "walks")
    else:
        kind = _order(F.lit(0.5), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0.5))
        steps = room.limit(0).select(F.col("s").alias("o"), F.array(F.struct(
            F.lit(0).alias("walk"), F.col("left").alias("limit"), kind.alias("last"))).alias("walks"))
    known = (named.drop("left").join(steps, F.col("s").eqNullSafe(F.col("o")), "left").drop("o")
             .join(gaps.select(F.col("s").alias("o"), F.col("left").alias("gap")),
                   F.col("s").eqNullSafe(F.col("o")), "left").drop("o"))
    known = materialize(known, "walked")
    off = F.abs(F.col("words") - F.col("gap"))
    unused = (rows.join(known.withColumnRenamed("s", "o"), F.col("s").eqNullSafe(F.col("o")))
              .where((F.col("chance") > 0) & (F.col("words") < 2 * F.col("gap")) & ~_sampled("words"))
              .groupBy("s").agg(F.min(F.struct(off.alias("off"), _order(
                  F.col("draw"), F.col("doc_id"), F.col("size"), F.col("chance")).alias("order"))).alias("c")))
    return materialize(
        known.join(unused.select(F.col("s").alias("o"), F.col("c.order").alias("closing")),
                   F.col("s").eqNullSafe(F.col("o")), "left").drop("o", "gap"), "plan")


def _sampled(words: str, at: str = "", draw="draw", doc_id="doc_id", size="size") -> Column:
    """Whether a row joined to its source's plan fits into the walk that meets it."""
    order = _order(F.col(draw), F.col(doc_id), F.col(size), F.col(f"{at}chance"))
    met = F.filter(F.col(f"{at}walks"), lambda w: w["last"].isNull() | (order <= w["last"]))
    return F.coalesce(F.get(met, F.lit(0))["limit"] >= F.col(words), F.lit(False))


def _copies(words: str, at: str = "", draw="draw", doc_id="doc_id", size="size") -> Column:
    """Copies of a row joined to its source's plan, whose columns begin with ``at``."""
    order = _order(F.col(draw), F.col(doc_id), F.col(size), F.col(f"{at}chance"))
    taken = (F.col(f"{at}chance") > 0) & (_sampled(words, at, draw, doc_id, size)
                                          | F.coalesce(order.eqNullSafe(F.col(f"{at}closing")), F.lit(False)))
    return F.col(f"{at}whole") + F.when(taken, 1).otherwise(0)


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("source").cast("string").alias("source"),
                       words("text").alias("size"), draw("doc_id", "text").alias("draw"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every document.

    Null texts have size 0; null is a source of its own, the last. Rows without an
    id take part. Rows with equal id, text and source are taken together; those
    without words only in whole copies. A source without words has target 0. An empty table gives
    no rows.
    """
    sized = materialize(sizes(docs), "sized")
    rows = units(sized).withColumn("times", F.when(F.col("size") > 0, F.col("words") / F.col("size")))
    # Without words a unit's number isn't in its words.
    bare = sized.where("size = 0").select("source", "draw", "doc_id", "size", F.lit(0).cast("bigint").alias("words"))
    full = rows.where("size > 0").select("source", "draw", "doc_id", "size", "words", F.explode(
        F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("col")
    return (full.unionAll(bare).join(plan(sized, weights, share, most), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("copies", F.when(F.col("size") > 0, _copies("words")).otherwise(F.col("whole")))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    sized = materialize(sizes(docs), "sized")
    found = plan(sized, weights, share, most).select(F.struct("*").alias("_plan"))
    again = materialize(units(sized).where("words > size").select(F.struct("*").alias("_unit")), "repeated")
    own = ("doc_id", "text", "source")
    rows = (narrow(docs, *own)
            .withColumns({"_id": F.col("doc_id").cast("bigint"), "_size": words("text"),
                          "_draw": draw("doc_id", "text")})
            .join(found, F.col("source").cast("string").eqNullSafe(F.col("_plan.s")))
            .join(again, (F.col("_draw") == F.col("_unit.draw")) & F.col("_id").eqNullSafe(F.col("_unit.doc_id"))
                  & F.col("source").cast("string").eqNullSafe(F.col("_unit.source")), "left")
            .withColumn("_words", F.coalesce("_unit.words", "_size")))
    copies = F.when(F.col("_size") > 0, _copies("_words", "_plan.", "_draw", "_id", "_size")).otherwise(
        F.col("_plan.whole")).cast("int")
    taken = (rows.withColumn("_copies", copies).where("_copies > 0")
             .select(*own, "_rest", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))))
    return widen(taken, docs.columns, *own)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2::DOUBLE * source_size AS most,
         row_number() OVER (ORDER BY 2::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
v AS (SELECT level FROM l WHERE level * w <= most ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, least(v.level * w, most) AS target,
         CASE WHEN source_size > 0 THEN least(v.level * w, most) / source_size ELSE 0 END AS rate
  FROM r, v),
p AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS chance,
         target - floor(rate)::BIGINT * source_size AS room FROM t),
u AS (
  SELECT source, doc_id, size, draw, (size * count(*))::BIGINT AS words FROM d
  WHERE size > 0 GROUP BY source, doc_id, size, draw),
o AS (
  SELECT u.*, p.room, row_number() OVER (
           PARTITION BY u.source ORDER BY (draw / (1 - draw)) / (chance / (1 - chance)), draw,
           doc_id NULLS FIRST, size) AS n
  FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source WHERE chance > 0),
walk AS (
  SELECT source, 0::BIGINT AS n, room AS gap, false AS taken FROM p WHERE chance > 0
  UNION ALL
  SELECT o.source, o.n, CASE WHEN o.words <= w.gap THEN w.gap - o.words ELSE w.gap END, o.words <= w.gap
  FROM walk w JOIN o ON o.source IS NOT DISTINCT FROM w.source AND o.n = w.n + 1),
g AS (SELECT source, min(gap) AS gap FROM walk GROUP BY source),
w AS (
  SELECT o.*, walk.taken, g.gap FROM o JOIN walk ON o.source IS NOT DISTINCT FROM walk.source AND o.n = walk.n
  JOIN g ON o.source IS NOT DISTINCT FROM g.source),
e AS (
  SELECT source, n FROM w WHERE NOT taken AND words < 2 * gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(words - gap), n) = 1),
x AS (
  SELECT w.source, w.draw, w.doc_id, w.size, w.taken OR e.n IS NOT NULL AS taken
  FROM w LEFT JOIN e ON w.source IS NOT DISTINCT FROM e.source AND w.n = e.n)
SELECT d.doc_id, d.size, p.source_size, p.target,
       ((p.whole + CASE WHEN x.taken THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.draw = x.draw AND d.size = x.size
           AND d.doc_id IS NOT DISTINCT FROM x.doc_id
"""
