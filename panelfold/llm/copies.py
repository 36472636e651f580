"""Pairs of shingle sets: exact bounds before they meet, exact comparison after.

Sets are sorted arrays of 64-bit shingle hashes. Two sets are near at ``percent`` if
100 * intersection >= percent * union, which is
(100 + percent) * intersection >= percent * (size + size).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelfold.session import materialize

# Sets compared with one copy of their partner; bits of a parity map; pairs looked at in one step;
# rows of one key that a task holds, rows that it takes together.
PARTNERS, LEAST_WIDTH, MOST_WIDTH, WORK, TILE_ROWS, HELD = 64, 64, 2048, 1 << 19, 1024, 1 << 13


def least_shared(total, percent: int):
    """Smallest intersection of two near sets whose sizes sum to ``total``."""
    return -(-percent * total // (100 + percent))


def parity(codes: np.ndarray) -> bytes:
    """One bit per residue of the codes: the parity of their number.

    A code in one set only turns one bit, so two sets differ in at least as many
    codes as their maps do in bits. The width is a power of two, twice the size at
    least within bounds; a wider map folds to a narrower one.
    """
    width = int(min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (2 * max(len(codes), 1) - 1).bit_length())))
    odd = np.bincount((codes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class ParityMaps:
    """Maps of many sets, for bounds on pairs of them."""

    def __init__(self, maps: list[bytes]):
        self.width = np.fromiter((len(m) for m in maps), np.int64, len(maps))
        self.place = np.zeros((2, len(maps)), np.int64)
        self.rows = {}
        for width in np.unique(self.width):
            own = np.flatnonzero(self.width == width)
            wide = np.flatnonzero(self.width == 2 * width)
            data = np.frombuffer(b"".join(maps[k] for k in own), np.uint64).reshape(len(own), -1)
            halves = np.frombuffer(b"".join(maps[k] for k in wide), np.uint64).reshape(len(wide), 2, width // 8)
            self.place[0, own] = np.arange(len(own))
            self.place[1, wide] = len(own) + np.arange(len(wide))
            self.rows[width] = np.concatenate([data, halves[:, 0] ^ halves[:, 1]])

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At least so many codes are in one of the two sets only."""
        out = np.zeros(len(a), np.int64)
        width = np.minimum(self.width[a], self.width[b])
        for w, rows in self.rows.items():
            here = np.flatnonzero((width == w) & (np.maximum(self.width[a], self.width[b]) <= 2 * w))
            step = max(1, (WORK * 8) // int(w))
            for k in range(0, len(here), step):
                at = here[k:k + step]
                x = self.place[(self.width[a[at]] != w).astype(np.int64), a[at]]
                y = self.place[(self.width[b[at]] != w).astype(np.int64), b[at]]
                out[at] = np.bitwise_count(rows[x] ^ rows[y]).sum(axis=1, dtype=np.int64)
        return out


class Forest:
    """Classes of labels that are joined pair by pair."""

    def __init__(self, labels: np.ndarray):
        names, self.of = np.unique(labels, return_inverse=True)
        self.parent = np.arange(len(names))

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if (above == self.parent).all():
                return self.parent[self.of]
            self.parent = above

    def _find(self, i):
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of the pairs that brought two classes together."""
        used = []
        for k, (x, y) in enumerate(zip(self.of[a].tolist(), self.of[b].tolist())):
            x, y = self._find(x), self._find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                used.append(k)
        return np.array(used, np.int64)


def later_rows(end: np.ndarray, work: int = WORK):
    """Pairs (i, j) of rows with i < j < end[i], about ``work`` at a time."""
    later = end - np.arange(len(end)) - 1
    cost = np.cumsum(later)
    at = 0
    while at < len(end):
        done = cost[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(cost, done + work, "right")))
        i = np.repeat(np.arange(at, stop), later[at:stop])
        if len(i):
            first = np.repeat(np.cumsum(later[at:stop]) - later[at:stop], later[at:stop])
            yield i, i + 1 + np.arange(len(i)) - first
        at = stop


def whole_keys(batches, rows: int = HELD):
    """Tables of sorted batches, cut between the values of their first column."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(0).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        size = len(keys) - cut
    if size:
        yield pa.Table.from_batches(held)


def verified(pairs: DataFrame, codes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets in ``codes`` (set, codes) are near.

    ``u`` of many pairs is sent once for every ``PARTNERS`` of them, each ``v`` once a
    pair; arrays meet in a stream, two at a time.
    """
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    x = codes.select(F.col("set").alias("u"), "codes")
    y = codes.select(F.col("set").alias("v"), "codes")
    hubs = (parts.join(x, "u").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("u", "part", F.lit(None).cast("bigint").alias("v"), "codes"))
    others = (pairs.join(parts, "u")
              .withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts").cast("bigint")).cast("int"))
              .select("u", "part", "v").join(y, "v").select("u", "part", "v", "codes"))

    def run(batches):
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            u, v = batch.column(0), batch.column(2)
            lists = batch.column(3)
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            ends = lists.offsets.to_numpy()
            lone, good = v.is_null().to_numpy(zero_copy_only=False), []
            for k in range(len(batch)):
                own = values[ends[k]:ends[k + 1]]
                if lone[k]:
                    hub = own.copy()
                    continue
                total = len(hub) + len(own)
                a, b = (hub, own) if len(hub) < len(own) else (own, hub)
                if not len(a) or (100 * len(a) < percent * len(b)):
                    continue
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                if (100 + percent) * int((b[at] == a).sum()) >= percent * total:
                    good.append(k)
            rows = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([u.take(rows), v.take(rows)], names=["u", "v"])

    return (hubs.unionAll(others).repartition("u", "part").sortWithinPartitions("u", "part", "v")
            .mapInArrow(run, "u bigint, v bigint"))


class BitFilter:
    """A set of hashes as bits of bounded number; says yes to some others too."""

    def __init__(self, hashes: DataFrame, most_bits: int = 1 << 27):
        """``hashes`` has one bigint column ``hash``; at most most_bits / 64 rows reach the driver."""
        hashes = materialize(hashes, "filter")
        self.bits = min(most_bits, max(1 << 16, 1 << (16 * hashes.count()).bit_length()))
        place = F.col("hash").bitwiseAND(F.lit(self.bits - 1))
        rows = (hashes.groupBy(F.shiftright(place, 6).alias("w"))
                .agg(F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {self.bits - 1}) & 63 as int))")).alias("b"))
                .toArrow())
        words = np.zeros(self.bits // 64, np.int64)
        words[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
        self.words = hashes.sparkSession.sparkContext.broadcast(words.view(np.uint8))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.words.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0
