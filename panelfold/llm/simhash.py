"""SimHash near-duplicates through a Gray-order hierarchical index."""

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelfold.llm.components import components
from panelfold.llm.copies import BitFilter, Forest, ParityMaps, least_shared, parity, whole_keys
from panelfold.llm.ngramjoin import digests, lists, one_each, open_sets, prints as set_prints, set_components, sets_of
from panelfold.llm.rows import narrow, widen
from panelfold.llm.textscan import as_bytes, mix, pieces
from panelfold.session import materialize

RADIUS = 3
GROUP_ROWS = 4096
SPREAD = 4
# Bits fixed after each routing level, out of 64: every level cuts what is left
# into four segments, of which two close fingerprints share at least one.
LEVELS = 5
# Near copies as ``keep_one`` has them: words of a shingle, least Jaccard in per cent, odds that
# routing parts a pair just there, fingerprints of a group, and the bits that may
# differ in the routed fingerprint and in both (three deviations above such a pair's mean).
COPY_WIDTH, COPY_PERCENT, COPY_MISS, COPY_GROUP = 5, 80, 0.005, 512
COPY_RADIUS, COPY_BOTH = 19, 32
# Rows of a group that meet in one task, rows that a task takes together, pairs of one search.
COPY_TILE, HELD_NODES, INDEX_WORK = 4096, 1 << 14, 1 << 20


# ---- fingerprints ---------------------------------------------------------

def simhash(texts: list[bytes], width: int = 3, seed: int = 42, block: int = 1 << 16) -> np.ndarray:
    """Majority fingerprint of each text as unsigned 64-bit numbers.

    Words are runs without ASCII white space, A-Z in lower case; a shingle is
    ``width`` of them joined by blanks, repeats included. A text of fewer words is
    one shingle; without words its fingerprint is zero.
    """
    out = np.zeros(len(texts), np.uint64)
    hashed = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        count = max(1, len(words) - width + 1)
        ones = np.zeros(64, np.int64)
        for start in range(0, count, block):
            part = words[start:min(start + block, count) + width - 1]
            shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) \
                if len(words) >= width else [b" ".join(words)]
            codes = np.fromiter((hashed(s, seed) for s in shingles), np.uint64)
            bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``simhash`` (the fingerprint's 64 bits as a bigint)."""
    keep = list(keep)
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_simhash_text"))
    schema = docs.select(*keep).withColumn("simhash", F.lit(0).cast("bigint")).schema

    def run(batches):
        for batch in pieces(batches, "_simhash_text"):
            codes = simhash(as_bytes(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(codes.view(np.int64))],
                names=[*keep, "simhash"])

    return source.mapInArrow(run, schema)


def hexadecimal(column="simhash"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


# ---- the index ------------------------------------------------------------

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence of Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index of the codes of many groups, all levels at once.

    Codes lie in Gray order within their group. A node stands for up to ``SPREAD``
    nodes below and keeps the bits that all of them share (``mask``, ``pattern``); a
    node below keeps only the bits that are not settled above, so the difference
    to a query adds up on the way down and a whole group is dropped once it
    exceeds the radius.
    """

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), groups))
        self.codes, group = codes[self.order], groups[self.order]
        self.n = len(codes)
        ones = np.full(self.n, ~np.uint64(0))
        # Bottom first: (pattern, mask, first child, children, first leaf, last leaf)
        place = np.arange(self.n)
        levels = [dict(pattern=self.codes, mask=ones, first=place, last=place)]
        owner = group
        low, high = self.codes, self.codes
        while True:
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[start, len(owner)])
            if len(start) == len(owner):
                break
            inner = np.arange(len(owner)) - np.repeat(start, size)
            begin = np.flatnonzero(inner % SPREAD == 0)
            low = np.bitwise_and.reduceat(low, begin)
            high = np.bitwise_or.reduceat(high, begin)
            below = levels[-1]
            count = np.diff(np.r_[begin, len(owner)])
            mask = ~(low ^ high)
            levels.append(dict(pattern=low, mask=mask, child=begin, count=count,
                               first=below["first"][begin],
                               last=below["last"][begin + count - 1]))
            below["rest"] = below["mask"] & ~np.repeat(mask, count)
            owner = owner[begin]
        self.levels = levels
        top = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
        self.root = top
        self.group_size = np.bincount(top)[top] if self.n else top

    def links(self, labels: np.ndarray, queries: np.ndarray, radius: int):
        """Pairs (query, later leaf) within the radius whose labels differ."""
        spans = []
        for level in self.levels:
            lows = np.minimum.reduceat(labels, level["first"])
            highs = np.maximum.reduceat(labels, level["first"])
            spans.append((lows, highs))
        query, node = queries, self.root[queries]
        level = self.levels[-1]
        far = np.bitwise_count((self.codes[query] ^ level["pattern"][node]) & level["mask"][node])
        for depth in range(len(self.levels) - 1, -1, -1):
            level, (lows, highs) = self.levels[depth], spans[depth]
            mine = labels[query]
            keep = (far <= radius) & (level["last"][node] > query) \
                & ((lows[node] != mine) | (highs[node] != mine))
            query, node, far = query[keep], node[keep], far[keep]
            if depth == 0:
                return query, node
            count = level["count"][node]
            child = np.repeat(level["child"][node], count) \
                + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            query, far = np.repeat(query, count), np.repeat(far, count)
            below = self.levels[depth - 1]
            far = far + np.bitwise_count(
                (self.codes[query] ^ below["pattern"][child]) & below["rest"][child])
            node = child


def _find(parent, i):
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent = above


def local_stars(groups: np.ndarray, codes: np.ndarray, radius: int = RADIUS,
                work: int = 1 << 20):
    """Index positions (member, root) that connect all codes of a group within the radius.

    Links inside one class are left out: a node whose leaves are all in the query's
    class is dropped whole, so a dense group costs about its size, not its square.
    """
    index = GrayIndex(groups, codes)
    parent = np.arange(index.n)
    if index.n > 1:
        near = np.bitwise_count(index.codes[1:] ^ index.codes[:-1]) <= radius
        near &= index.root[1:] == index.root[:-1]
        runs = np.flatnonzero(np.r_[True, ~near])
        parent = np.repeat(runs, np.diff(np.r_[runs, index.n]))
    lonely = index.group_size == 1
    queries = np.flatnonzero(~lonely)
    cost = np.cumsum(index.group_size[queries])
    at = 0
    while at < len(queries):
        done = cost[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(cost, done + work, "right")))
        parent = _roots(parent)
        a, b = index.links(parent, queries[at:end], radius)
        if len(a):
            pairs = np.unique(np.stack([parent[a], parent[b]], 1), axis=0)
            for x, y in pairs.tolist():
                x, y = _find(parent, x), _find(parent, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        at = end
    parent = _roots(parent)
    moved = np.flatnonzero(parent != np.arange(index.n))
    return index.order[moved], index.order[parent[moved]]


# ---- routing on Spark -----------------------------------------------------

def _segments(mask: int) -> list[int]:
    """Four masks that together make up ``mask``'s bits, top bits first."""
    bits = [1 << i for i in range(63, -1, -1) if mask >> i & 1]
    size = -(-len(bits) // 4)
    return [sum(bits[k * size:(k + 1) * size]) for k in range(4)]


def _masks(level: int) -> list[int]:
    """Masks fixed at ``level``: 4 of 16 bits, 16 of 28, 64 of 37, 256 of 44, 1,024 of 49."""
    if level == 0:
        return [0]
    full = (1 << 64) - 1
    return [above | part for above in _masks(level - 1) for part in _segments(full & ~above)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _routed(nodes: DataFrame, level: int) -> DataFrame:
    """Each node once for every mask: nodes within the radius share a key."""
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(level)])
    return (nodes.select("*", F.explode(masks).alias("mask"))
            .withColumn("key", F.xxhash64("mask", F.col("simhash").bitwiseAND(F.col("mask")))))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)`` of nodes (simhash, rep), distinct fingerprints: enough links to
    connect all fingerprints at ``radius`` (at most 3) or fewer differing bits.

    Fingerprints at three or fewer differing bits agree on one of four segments.
    Each goes to its four segments' groups; keys with over ``GROUP_ROWS`` rows are
    cut again on four segments of the other bits, and so on. At the last level
    49 bits are fixed, so a group can't exceed 2**15 fingerprints.
    """
    if radius > 3:
        raise ValueError("four segments find at most three differing bits")
    ready, rest = [], nodes
    for level in range(1, LEVELS + 1):
        routed = _routed(rest, level)
        if level == LEVELS:
            ready.append(routed.select("key", "simhash", "rep"))
            break
        crowded = materialize(routed.groupBy("key").count()
                              .where(F.col("count") > GROUP_ROWS).select("key"), "crowded")
        if crowded.isEmpty():
            ready.append(routed.select("key", "simhash", "rep"))
            break
        ready.append(routed.join(crowded, "key", "left_anti").select("key", "simhash", "rep"))
        rest = materialize(routed.join(crowded, "key", "left_semi")
                           .select("simhash", "rep").distinct(), "crowded_nodes")

    def search(batches):
        held = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = rows if held is None else [np.concatenate(p) for p in zip(held, rows)]
            if len(held[0]) < 1 << 16:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
            if cut:
                yield from stars([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield from stars(held)

    def stars(rows):
        key, code, rep = rows
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        u, v = local_stars(group, code.view(np.uint64), radius)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(rep[u]), pa.array(rep[v])], names=["u", "v"])

    return (reduce(DataFrame.unionAll, ready).repartition("key").sortWithinPartitions("key")
            .mapInArrow(search, "u bigint, v bigint"))


def _named(nodes: DataFrame, radius: int) -> DataFrame:
    """The component of every distinct fingerprint."""
    found = components(links(nodes.where("rep is not null"), radius))
    return (nodes.join(found, nodes.rep == found.node, "left")
            .select("simhash", F.coalesce("component", "rep").alias("component_id")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every row's ``doc_id``, ``simhash`` and ``component_id``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest doc_id reachable. Null texts count as empty and have fingerprint
    zero, as texts without words do. A row without doc_id gets the component of its
    fingerprint but doesn't link (null if no row with that fingerprint has an
    id). Repeated rows stay. An empty table gives no rows. Other columns aren't read.
    """
    prints = materialize(fingerprints(docs.select(F.col("doc_id").cast("bigint"), "text")),
                         "simhash")
    nodes = materialize(prints.groupBy("simhash").agg(F.min("doc_id").alias("rep")), "nodes")
    named = materialize(_named(nodes, radius), "named")
    return prints.join(named, "simhash").select("doc_id", "simhash", "component_id")


# ---- near copies by exact Jaccard -------------------------------------------

def majorities(codes: np.ndarray, ends: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """The fingerprint of each set ``codes[ends[k]:ends[k + 1]]``."""
    ones = np.zeros((len(ends) - 1, 64), np.int64)
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    for start in range(0, len(codes), block):
        part, row = codes[start:start + block], rows[start:start + block]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        ones[row[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(ends)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _copy_nodes(rows: DataFrame, may: DataFrame, width: int) -> DataFrame:
    """``set, n, codes, bits, a, b`` of the open sets: shingles, their parity map and two
    independent fingerprints."""
    chosen = BitFilter(may.select(F.col("row_key").alias("hash")))

    def run(batches):
        for part, codes, ends in sets_of(batches, chosen, width):
            own = [codes[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(digests(codes, ends)), pa.array(np.diff(ends)), lists(own),
                 pa.array([parity(s) for s in own], pa.binary()),
                 pa.array(majorities(codes, ends).view(np.int64)),
                 pa.array(majorities(mix(codes), ends).view(np.int64))],
                names=["row_key", "set", "n", "codes", "bits", "a", "b"])

    return one_each(rows.mapInArrow(run, "row_key bigint, set bigint, n bigint, codes array<bigint>, bits binary, "
                                         "a bigint, b bigint"), may)


def route_masks(count: int, threshold: float, miss: float = COPY_MISS) -> list[int]:
    """Random bit masks that route ``count`` fingerprints to groups of some hundreds.

    Two sets of Jaccard J have fingerprints that differ in a share acos(2J / (1 + J)) / pi
    of the bits. There are so many masks that all of them part two sets at the
    threshold with odds of ``miss`` at most; nearer sets are parted less.
    """
    bits = min(24, max(6, int(np.ceil(np.log2(max(count, 1) / COPY_GROUP)))))
    differ = np.arccos(2 * threshold / (1 + threshold)) / np.pi
    masks = int(np.ceil(np.log(miss) / np.log1p(-(1 - differ) ** bits)))
    rng = np.random.default_rng(7)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(masks)]


def copy_pairs(nodes: DataFrame, labels: DataFrame, masks: list[int], forest: bool, percent: int) -> DataFrame:
    """``u, v``: pairs of nodes with different labels that may be near.

    Masks route fingerprints to groups; groups of one label are left out. A task searches
    its groups through the Gray-order index; what is near in both fingerprints must also
    pass the bound of the parity maps, which is exact. With ``forest`` a task sends only pairs
    that bring labels together, and crowded groups are cut by bits of the other
    fingerprint; else they are cut into tiles, so that every pair of a group meets.
    """
    def key(k, mask):
        code, other = ("a", "b") if k % 2 else ("b", "a")
        return F.struct(F.xxhash64(F.lit(k), F.col(code).bitwiseAND(F.lit(_signed(mask)))).alias("key"),
                        F.lit(k).alias("k"))

    routed = (nodes.select("set", "a", "b").join(labels, "set")
              .withColumn("r", F.explode(F.array(*[key(k, m) for k, m in enumerate(masks)])))
              .select("set", "label", "b", "r.key", (F.col("r.k") % 2 == 1).alias("odd")))
    mixed = materialize(
        routed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                  F.count("*").alias("size"))
        .where("low < high").select("key", F.ceil(F.col("size") / COPY_TILE).cast("int").alias("tiles")), "mixed_groups")
    met = routed.join(mixed, "key")
    if forest:
        cut = F.pmod(F.xxhash64(F.col("b").bitwiseAND(F.lit(0xFF))), F.col("tiles").cast("bigint"))
        met = met.select("set", "odd", F.xxhash64("key", cut).alias("key"), F.lit(0).alias("block"),
                         F.lit(False).alias("cross"))
    else:
        block = F.pmod(F.xxhash64("set"), F.col("tiles").cast("bigint")).cast("int")
        met = (met.withColumn("block", block).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
               .select("set", "odd", F.xxhash64("key", F.least("block", "tile"), F.greatest("block", "tile")).alias("key"),
                       "block", (F.col("block") != F.col("tile")).alias("cross")))
    # The groups are light until here; fingerprints and maps join what is left of them.
    rows = (met.join(nodes.select("set", "n", "bits", "a", "b").join(labels, "set"), "set")
            .withColumns({"code": F.when(F.col("odd"), F.col("a")).otherwise(F.col("b")),
                          "other": F.when(F.col("odd"), F.col("b")).otherwise(F.col("a"))}))
    rows = rows.select("key", "code", "other", "set", "label", "n", "block", "cross", "bits")

    def run(batches):
        for table in whole_keys(batches, HELD_NODES):
            keys, code, other, name, label, n, block, cross = (table.column(i).to_numpy() for i in range(8))
            group = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
            index = GrayIndex(group, code.view(np.uint64))
            o = index.order
            other, name, label, n, block, cross = (x[o] for x in (other, name, label, n, block, cross))
            bits = table.column(8).to_pylist()
            maps, trees = ParityMaps([bits[k] for k in o.tolist()]), Forest(label)
            queries = np.flatnonzero(index.group_size > 1)
            cost = np.cumsum(index.group_size[queries])
            at = 0
            while at < len(queries):
                end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + INDEX_WORK, "right")))
                i, j = index.links(trees.roots() if forest else trees.of, queries[at:end], COPY_RADIUS)
                at = end
                far = (np.bitwise_count(index.codes[i] ^ index.codes[j])
                       + np.bitwise_count(other[i].view(np.uint64) ^ other[j].view(np.uint64)))
                keep = ((far <= COPY_BOTH) & (percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j]))
                        & (~cross[i] | (block[i] != block[j])))
                i, j = i[keep], j[keep]
                total = n[i] + n[j]
                near = maps.differ(i, j) <= total - 2 * least_shared(total, percent)
                i, j = i[near], j[near]
                if forest:
                    used = trees.join(i, j)
                    i, j = i[used], j[used]
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(name[i], name[j])), pa.array(np.maximum(name[i], name[j]))],
                        names=["u", "v"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u bigint, v bigint").distinct()


def keep_one(docs: DataFrame, width: int = COPY_WIDTH, percent: int = COPY_PERCENT) -> DataFrame:
    """The documents, one of each group of near copies, with all their columns.

    Near copies share at least ``percent`` of a hundred (Jaccard) of their distinct shingles of
    ``width`` words, exactly verified; groups are connected. Only sets that share enough
    shingles with others at all are looked at (``ngramjoin.open_sets``, no near copy is
    lost there); candidates come from fingerprints (``route_masks``), so a pair just at
    the threshold can be missed. The row with the smallest doc_id stays, of rows that
    repeat it the one with the smallest digest of all columns, and of equal rows one. A
    row without doc_id stays only where its group has no id at all. Texts without words
    are one group.
    """
    columns = docs.columns
    rows = narrow(docs, "doc_id", "text")
    rows = rows.withColumn("_digest", F.xxhash64("doc_id", "text", "_rest"))
    texts = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_digest").alias("row_key"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    prints = materialize(set_prints(texts, width), "copy_prints")
    may, _ = open_sets(prints, texts, width, percent)
    nodes = _copy_nodes(texts, may, width)
    masks = route_masks(nodes.count(), percent / 100)
    # Links that connect groups of copies first; then every pair that is near and still apart.
    named = set_components(nodes, [lambda labels: copy_pairs(nodes, labels, masks, True, percent),
                                   lambda labels: copy_pairs(nodes, labels, masks, False, percent)], percent)
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_key")
    leading = prints.groupBy("set").agg(F.min(first).alias("k")).join(named, "set", "left")
    kept = leading.groupBy(F.coalesce("component", "set")).agg(F.min("k").alias("k"))
    kept = materialize(kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.row_key").alias("kept_digest")), "kept")
    same = (rows._digest == F.col("kept_digest")) & rows.doc_id.cast("bigint").eqNullSafe(F.col("kept_id"))
    out = rows.join(kept, same, "left_semi")
    again = materialize(prints.groupBy("doc_id", "row_key").count().where("count > 1")
                        .select(F.col("doc_id").alias("kept_id"), F.col("row_key").alias("kept_digest")), "again")
    if not again.isEmpty():
        once = out.join(again, same, "left_anti")
        out = once.unionAll(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "_digest"]))
    return widen(out, columns, "doc_id", "text")
