"""Documents that share most of their word n-grams: a grouped prefix join."""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelfold.llm.components import components
from panelfold.llm.copies import (TILE_ROWS, BitFilter, Forest, ParityMaps, later_rows, least_shared, parity,
                                  verified, whole_keys)
from panelfold.llm.textscan import as_bytes, pieces
from panelfold.llm.wordscan import Words, byte_table, chain
from panelfold.session import materialize

WIDTH, PERCENT = 5, 80
TABLE = byte_table(b"\x20\x09\x0A\x0B\x0C\x0D")
# A shingle of more documents comes last in the order; per cent of a set that is looked at
# beyond its prefix; sets of one unit; bytes of text taken at once.
COMMON, BEYOND, UNIT_SETS, PIECE = 256, 10, 8, 1 << 19
# Shingles of one slice of their places, spare bits of a place, shingles and rows of one chunk.
SLICE_CODES, SPARE_BITS, CHUNK_CODES, CHUNK_ROWS = 1 << 19, 6, 1 << 19, 1 << 14


def shingle_sets(texts: list[bytes], width: int = WIDTH):
    """Distinct sorted shingle hashes of all texts in one array, and where each text's begin.

    A text of fewer words is one shingle; without words its set is empty.
    """
    words = Words(texts, TABLE)
    count = np.bincount(words.row, minlength=len(texts))
    first = np.cumsum(count) - count
    codes, rows = [], []
    for w in range(1, width + 1):
        runs = chain(words.hash, w)
        if w < width:
            row = np.flatnonzero(count == w)
            at = first[row]
        else:
            at = np.flatnonzero(words.row[:len(runs)] == words.row[w - 1:]) if len(runs) else np.zeros(0, np.int64)
            row = words.row[at]
        codes.append(runs[at])
        rows.append(row)
    codes, rows = np.concatenate(codes), np.concatenate(rows)
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    new = np.r_[True, (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])] if len(codes) else np.zeros(0, bool)
    codes, rows = codes[new], rows[new]
    return codes, np.r_[0, np.cumsum(np.bincount(rows, minlength=len(texts)))]


def needed(n, percent: int):
    """Shingles that a set of ``n`` shares with any near set at least."""
    return -(-percent * n // 100)


def looked_at(n: int, percent: int) -> int:
    """A near set has all but n - needed of these, so at least some beyond that are shared."""
    return min(n, n - needed(n, percent) + 1 + n * BEYOND // 100)


def digests(codes, ends) -> np.ndarray:
    data = codes.tobytes()
    return np.array([xxhash.xxh64_intdigest(data[8 * i:8 * j]) for i, j in zip(ends[:-1], ends[1:])],
                    np.uint64).view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    values = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def prints(rows: DataFrame, width: int) -> DataFrame:
    """``doc_id, row_key, set, n`` of every row; ``set`` is a digest of its shingles."""
    def run(batches):
        for batch in pieces(batches, limit=PIECE):
            codes, ends = shingle_sets(as_bytes(batch.column(2)), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests(codes, ends)), pa.array(np.diff(ends))],
                names=["doc_id", "row_key", "set", "n"])

    return rows.mapInArrow(run, "doc_id bigint, row_key bigint, set bigint, n bigint")


def _slices(rows: DataFrame, firsts: BitFilter, width: int, percent: int, bits: int, parts: int) -> DataFrame:
    """The smallest hashes of every set that ``firsts`` lets through, as places of ``bits`` bits.

    A task cuts its rows into chunks and sends each chunk's places by ``slice``, the top
    ``parts`` bits: sorted, as counts of their upper bits (``high``) and their 16 lower ones,
    with the row of the chunk each is of (``owner``). A place of over ``COMMON`` rows of a chunk
    is sent once more than that, as no more is asked of it. One row names the ``sets`` of a chunk.
    """
    inner, most = bits - parts, COMMON

    def sent(held, names):
        names = np.concatenate(names)
        chunk = np.uint64(xxhash.xxh64_intdigest(names.tobytes(), TaskContext.get().partitionId())).view(np.int64)
        places = np.concatenate(held) & np.uint64((1 << bits) - 1)
        owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(codes) for codes in held])
        order = np.argsort(places)
        places, owner = places[order], owner[order]
        kept = np.ones(len(places), bool)
        kept[most + 1:] = places[most + 1:] != places[:-most - 1]
        places, owner = places[kept], owner[kept]
        part = (places >> np.uint64(inner)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        span = list(zip(first.tolist(), np.r_[first[1:], len(part)].tolist()))
        low = (places & np.uint64(0xFFFF)).astype(np.uint16)
        high = ((places & np.uint64((1 << inner) - 1)) >> np.uint64(16)).astype(np.int64)
        count = len(span)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[part[first], chunk]), pa.array(np.full(count + 1, chunk)),
             pa.array([None] * count + [names.tobytes()], pa.binary()),
             pa.array([np.bincount(high[i:j], minlength=1 << (inner - 16)).astype(np.uint32).tobytes()
                       for i, j in span] + [None], pa.binary()),
             pa.array([low[i:j].tobytes() for i, j in span] + [None], pa.binary()),
             pa.array([owner[i:j].tobytes() for i, j in span] + [None], pa.binary())],
            names=["slice", "chunk", "sets", "high", "low", "owner"])

    def run(batches):
        held, names, size = [], [], 0
        for _, codes, ends in sets_of(batches, firsts, width):
            names.append(digests(codes, ends))
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
                held.append(codes[i:i + looked_at(j - i, percent)].copy())
                size += len(held[-1])
                if size >= CHUNK_CODES or len(held) == CHUNK_ROWS:
                    done = len(held) - sum(map(len, names[:-1]))
                    yield from sent(held, [*names[:-1], names[-1][:done]])
                    held, names, size = [], [names[-1][done:]], 0
        if size:
            yield from sent(held, names)

    return rows.mapInArrow(run, "slice bigint, chunk bigint, sets binary, high binary, low binary, owner binary")


def _told(sliced: DataFrame, bits: int, parts: int) -> DataFrame:
    """``chunk, sets`` as they came, ``chunk, dense, own`` and ``hash``: which rows have places
    that no other row has (as a count for each row of the chunk, or as a list), and the
    places of over ``COMMON`` rows."""
    inner, common = bits - parts, COMMON

    def sent(held):
        chunks, dense, own = list(held), [], []
        for chunk in chunks:
            rows = np.concatenate(held[chunk])
            dense.append(len(rows) > int(rows.max()))
            own.append((np.minimum(np.bincount(rows), 0xFFFF).astype(np.uint16) if dense[-1] else rows).tobytes())
        yield batch(chunk=pa.array(chunks, pa.int64()), dense=pa.array(dense, pa.bool_()), own=pa.array(own, pa.binary()))

    def batch(**given):
        count = len(next(iter(given.values())))
        kinds = {"chunk": pa.int64(), "sets": pa.binary(), "dense": pa.bool_(), "own": pa.binary(), "hash": pa.int64()}
        return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(count, kind)) for k, kind in kinds.items()],
                                          names=list(kinds))

    def run(batches):
        held, size = {}, 0
        for table in whole_keys(batches, 1):
            named = table.filter(table.column(2).is_valid()).combine_chunks()
            for part in named.to_batches():
                yield batch(chunk=part.column(1), sets=part.column(2))
            table = table.filter(table.column(2).is_null())
            keys = table.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else []
            for i, j in zip(edges[:-1], edges[1:]):
                rows = table.slice(i, j - i)
                chunks = rows.column(1).to_pylist()
                high, low, owner = ([np.frombuffer(x, kind) for x in rows.column(k).to_pylist()]
                                    for k, kind in ((3, np.uint32), (4, np.uint16), (5, np.uint16)))
                places = np.concatenate([(np.repeat(np.arange(len(h), dtype=np.uint64), h) << np.uint64(16)) | l
                                         for h, l in zip(high, low)])
                ordered = np.sort(places)
                new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
                times, ordered = np.diff(new), ordered[new[:-1]]
                lone = times[np.searchsorted(ordered, places)] == 1
                many = ordered[times > common]
                if len(many):
                    yield batch(hash=pa.array(((np.uint64(keys[i]) << np.uint64(inner)) | many).view(np.int64)))
                ends = np.cumsum([len(x) for x in low])
                for chunk, rows_of, alone in zip(chunks, owner, np.split(lone, ends[:-1])):
                    if alone.any():
                        held.setdefault(chunk, []).append(rows_of[alone])
                        size += int(alone.sum())
                if size > CHUNK_CODES:
                    yield from sent(held)
                    held, size = {}, 0
        if held:
            yield from sent(held)

    return (sliced.repartition("slice").sortWithinPartitions("slice")
            .mapInArrow(run, "chunk bigint, sets binary, dense boolean, own binary, hash bigint"))


def _own_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """``set, own`` of the sets of one chunk."""
    names = [x for x in rows["sets"] if x is not None]
    sets = np.frombuffer(names[0], np.int64) if names else np.zeros(0, np.int64)
    own = np.zeros(len(sets), np.int64)
    for dense, data in zip(rows["dense"], rows["own"]):
        if data is not None and len(sets):
            found = np.frombuffer(data, np.uint16)
            found = found if dense else np.bincount(found)
            own[:len(found)] += found
    return pd.DataFrame({"set": sets[own > 0], "own": own[own > 0]})


def open_sets(printed: DataFrame, rows: DataFrame, width: int, percent: int):
    """Sets that may have a near set, and places (lower bits) of the shingles of over ``COMMON`` rows.

    A near set shares all but ``n - needed(n)`` shingles of a set, so a set with more
    shingles of its own among those looked at has none. One row of each set counts
    (more, where the filter lets them through); a shingle travels as a place of some bits with the
    number of its row. Shingles that fall on one place, or rows of one set that both count,
    make a set look less alone than it is, never more.
    """
    sets = materialize(
        printed.where("n > 0").groupBy("set")
        .agg(F.max("n").alias("n"),
             F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_key")).alias("first"))
        .select("set", "n", F.col("first.row_key").alias("row_key")), "distinct_sets")
    allowed = F.col("n") - F.expr(f"({percent} * n + 99) div 100")
    total = sets.agg(F.sum(F.least("n", allowed + 1 + F.expr(f"n * {BEYOND} div 100")))).first()[0] or 1
    bits = min(48, max(28, (total - 1).bit_length() + SPARE_BITS))
    parts = min(max(0, (-(-total // SLICE_CODES) - 1).bit_length()), bits - 16)
    firsts = BitFilter(sets.select(F.col("row_key").alias("hash")))
    told = materialize(_told(_slices(rows, firsts, width, percent, bits, parts), bits, parts), "shingles")
    lonely = (told.where("chunk is not null").groupBy("chunk")
              .applyInPandas(_own_counts, "set bigint, own bigint").groupBy("set").agg(F.max("own").alias("own")))
    may = sets.join(lonely, "set", "left").where(F.coalesce("own", F.lit(0)) <= allowed).select("set", "row_key")
    return materialize(may, "open_sets"), told.where("hash is not null").select("hash")


def sets_of(batches, chosen: BitFilter, width: int):
    """Pieces of (doc_id, row_key, text) whose key the filter lets through, with their shingle sets."""
    for batch in batches:
        wanted = chosen(batch.column(1).to_numpy(zero_copy_only=False))
        for part in pieces([batch.filter(pa.array(wanted))], limit=PIECE):
            yield part, *shingle_sets(as_bytes(part.column(2)), width)


def one_each(found: DataFrame, may: DataFrame) -> DataFrame:
    """The rows of ``found`` that ``may`` (set, row_key) names, one per set, written."""
    nodes = materialize(found.join(may, ["set", "row_key"], "left_semi").drop("row_key"), "nodes")
    if nodes.groupBy("set").count().where("count > 1").isEmpty():
        return nodes
    return materialize(nodes.dropDuplicates(["set"]), "nodes")  # rows repeat an id and a text


def _nodes(rows: DataFrame, may: DataFrame, common: BitFilter, width: int, percent: int) -> DataFrame:
    """``set, n, group, codes, prefix, bits`` of the open sets, one row each.

    The order puts common shingles last, else goes by hash. Sets of one size and
    one prefix are a group.
    """
    chosen = BitFilter(may.select(F.col("row_key").alias("hash")))

    def run(batches):
        for part, codes, ends in sets_of(batches, chosen, width):
            late = common(codes)
            own_sets, prefixes, groups, bits = [], [], [], []
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own, last = codes[i:j], late[i:j]
                take = j - i - needed(j - i, percent) + 1 if j > i else 0
                prefix = own[~last][:take]
                prefix = np.concatenate([prefix, own[last][:take - len(prefix)]])
                own_sets.append(own)
                prefixes.append(prefix)
                groups.append(xxhash.xxh64_intdigest(prefix.tobytes(), j - i))
                bits.append(parity(own))
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(digests(codes, ends)), pa.array(np.diff(ends)),
                 pa.array(np.array(groups, np.uint64).view(np.int64)), lists(own_sets), lists(prefixes),
                 pa.array(bits, pa.binary())],
                names=["row_key", "set", "n", "group", "codes", "prefix", "bits"])

    return one_each(rows.mapInArrow(run, "row_key bigint, set bigint, n bigint, `group` bigint, "
                                         "codes array<bigint>, prefix array<bigint>, bits binary"), may)


def group_pairs(nodes: DataFrame) -> DataFrame:
    """``u, v``: every set of a group with the group's first."""
    first = nodes.groupBy("group").agg(F.min("set").alias("u"), F.count("*").alias("sets")).where("sets > 1")
    return (nodes.select("group", F.col("set").alias("v")).join(first, "group").where("u <> v")
            .select("u", "v"))


def open_pairs(nodes: DataFrame, labels: DataFrame, forest: bool, percent: int) -> DataFrame:
    """``u, v``: pairs of sets with different labels that may be near.

    Units (sets of one group and label) meet in the lists of their prefix shingles; lists
    of one label are left out. Unit pairs go by size and place, then their sets by parity
    maps; all bounds are exact. With ``forest`` a task sends only pairs that bring labels
    together, and long lists are cut; else they are cut into tiles, so that every two
    units of a list meet.
    """
    known = nodes.select("set", "n", "group", "prefix", "bits").join(labels, "set")
    parts = (nodes.select("set", "group").join(labels, "set").groupBy("group", "label")
             .agg(F.ceil(F.count("*") / UNIT_SETS).alias("parts")).where("parts > 1"))
    part = F.pmod(F.xxhash64("set"), F.coalesce("parts", F.lit(1)))
    units = materialize(
        known.join(parts, ["group", "label"], "left").groupBy("group", "label", part.alias("part"))
        .agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.collect_list("set").alias("sets"),
             F.collect_list("bits").alias("maps"))
        .select(F.xxhash64("group", "label", "part").alias("unit"), "label", "n", "prefix", "sets", "maps"), "units")
    places = units.select("unit", "label", F.posexplode("prefix").alias("place", "token"))
    mixed = materialize(
        places.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                    F.count("*").alias("size"))
        .where("low < high").select("token", F.ceil(F.col("size") / TILE_ROWS).cast("int").alias("tiles")), "mixed_lists")
    block = F.pmod(F.col("unit"), F.col("tiles").cast("bigint")).cast("int")
    met = places.drop("label").join(mixed, "token").withColumn("block", block)
    if forest:
        met = met.select("unit", "place", F.xxhash64("token", "block").alias("key"), F.lit(0).alias("block"),
                         F.lit(False).alias("cross"))
    else:
        met = (met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
               .select("unit", "place", F.xxhash64("token", F.least("block", "other"),
                                                   F.greatest("block", "other")).alias("key"),
                       "block", (F.col("block") != F.col("other")).alias("cross")))
    # The lists are light until here; sets and maps join what is left of them.
    rows = (met.join(units.drop("prefix"), "unit")
            .select("key", "cross", "block", "label", "n", "place", "sets", "maps"))

    def run(batches):
        for table in whole_keys(batches):
            table = table.combine_chunks()
            key, cross, block, label, n, place = (table.column(i).to_numpy() for i in range(6))
            count = np.array([len(s) for s in table.column(6).to_pylist()])
            sets = np.concatenate([np.asarray(s, np.int64) for s in table.column(6).to_pylist()])
            maps = ParityMaps([m for each in table.column(7).to_pylist() for m in each])
            owner, begin = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
            trees = Forest(label)
            end = np.searchsorted(key, key, "right")
            for i, j in later_rows(end):
                roots = trees.roots() if forest else label
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                room = 1 + np.minimum(n[i] - place[i], n[j] - place[j]) - 1
                keep = ((roots[i] != roots[j]) & (100 * small >= percent * large)
                        & (room >= least_shared(n[i] + n[j], percent)) & (~cross[i] | (block[i] != block[j])))
                i, j = i[keep], j[keep]
                many = count[i] * count[j]
                pair = np.repeat(np.arange(len(i)), many)
                inner = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
                a, b = begin[i[pair]] + inner // count[j[pair]], begin[j[pair]] + inner % count[j[pair]]
                total = n[owner[a]] + n[owner[b]]
                near = (maps.differ(a, b) <= total - 2 * least_shared(total, percent)) & (sets[a] != sets[b])
                a, b = a[near], b[near]
                if forest and len(a):
                    used = trees.join(owner[a], owner[b])
                    a, b = a[used], b[used]
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(sets[a], sets[b])), pa.array(np.maximum(sets[a], sets[b]))],
                        names=["u", "v"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u bigint, v bigint").distinct()


def set_components(nodes: DataFrame, steps, percent: int) -> DataFrame:
    """``set, component`` of every node (set, codes): classes by verified links.

    Every step gives candidate pairs (u, v) for the labels reached so far; pairs that
    were compared before are not compared again.
    """
    codes = nodes.select("set", "codes")
    labels = nodes.select("set", F.col("set").alias("label"))
    links = tried = None
    for step in steps:
        pairs = step(labels)
        if tried is not None:
            ordered = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            pairs = pairs.join(ordered, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "pairs")
        sure = materialize(verified(pairs, codes, percent), "links")
        links, tried = (sure, pairs) if links is None else (links.unionAll(sure), tried.unionAll(pairs))
        found = materialize(components(links), "components")
        labels = materialize(
            nodes.select("set").join(found.withColumnRenamed("node", "set"), "set", "left")
            .select("set", F.coalesce("component", "set").alias("label")), "labels")
    return labels.select("set", F.col("label").alias("component"))


def _classes(nodes: DataFrame, percent: int) -> DataFrame:
    """First the sets of one group; then pairs that would connect what is apart, which joins
    large groups of copies at about the price of their size; then every pair still apart
    whose bounds allow a link. So no link that matters is lost, and no group of copies
    is written as all its pairs."""
    return set_components(nodes, [lambda labels: group_pairs(nodes),
                                  lambda labels: open_pairs(nodes, labels, True, percent),
                                  lambda labels: open_pairs(nodes, labels, False, percent)], percent)


def join_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Words are runs without ASCII white space, A-Z folded. Documents link when
    100 * intersection >= percent * union of their distinct shingles of ``width`` words;
    ``component_id`` is the smallest doc_id reachable. A text of fewer words is one
    shingle; null texts and texts without words link with nothing. Equal sets link
    always, so repeated rows do. A row without doc_id links as others do, but gives no
    component its name (null where no id is reachable). An empty table gives no rows.
    Other columns aren't read. Shingles and sets are told apart by 64-bit hashes.
    """
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("row_key"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    printed = materialize(prints(rows, width), "prints")
    may, common = open_sets(printed, rows, width, percent)
    nodes = _nodes(rows, may, BitFilter(common), width, percent)
    classes = _classes(nodes, percent)
    named = materialize(
        printed.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least")).join(classes, "set", "left")
        .withColumn("component", F.coalesce("component", "set")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = materialize(named.join(least, "component").select("set", "component_id"), "component_ids")
    full = printed.where("n > 0").join(names, "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = printed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"),
                                        F.col("doc_id").alias("component_id"))
    return full.unionAll(bare)
