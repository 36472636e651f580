"""Approximate nearest neighbours: a forest of random-projection trees, one queue, exact ranks."""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelfold.session import materialize

TREES, LEAVES = 8, 64
SAMPLE = 8192          # vectors the forest is fitted on, at most
PROBES = 64            # queries that set how far the search goes
RECALL = 0.95          # what those must reach
BLOCK = 4096           # rows, and queries, of a leaf that meet in one task


class Forest:
    """Trees whose nodes split by the plane between two random sample vectors."""

    def __init__(self, sample: np.ndarray, trees=TREES, leaves=LEAVES, seed=11):
        rng = np.random.default_rng(seed)
        self.planes, self.offsets, self.children, self.roots, self.leaves = [], [], [], [], 0
        least = max(1, -(-len(sample) // leaves))
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), least, rng))
        self.planes = np.array(self.planes).reshape(-1, sample.shape[1])
        self.offsets = np.array(self.offsets)

    def _grow(self, sample, rows, least, rng):
        """Node number, or -1 - leaf number."""
        if len(rows) > least:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            plane = a - b
            norm = np.linalg.norm(plane)
            if norm > 0:
                plane = plane / norm
                along = sample[rows] @ plane
                middle = float(np.median(along))
                left = along < middle
                if left.any() and not left.all():
                    node = len(self.planes)
                    self.planes.append(plane)
                    self.offsets.append(middle)
                    self.children.append(None)
                    self.children[node] = (self._grow(sample, rows[left], least, rng),
                                           self._grow(sample, rows[~left], least, rng))
                    return node
        self.leaves += 1
        return -self.leaves

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.planes.T - self.offsets

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        margins = self.margins(vectors)
        out = np.empty((len(vectors), len(self.roots)), np.int32)
        for tree, root in enumerate(self.roots):
            waiting = [(root, np.arange(len(vectors)))]
            while waiting:
                node, rows = waiting.pop()
                if node < 0:
                    out[rows, tree] = -1 - node
                    continue
                right = margins[rows, node] >= 0
                low, high = self.children[node]
                waiting += [(low, rows[~right]), (high, rows[right])]
        return out

    def search(self, margins, counts, budget):
        """Leaves of one query, nearest first, until they hold ``budget`` rows.

        One queue serves all trees. What lies beyond a plane is as far as the squares
        of the margins crossed on the way add up to.
        """
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < budget:
            far, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                low, high = self.children[node]
                near, other = (high, low) if margin >= 0 else (low, high)
                heapq.heappush(queue, (far + margin * margin, other))
                node = near
            found.append(-1 - node)
            held += counts[-1 - node]
        return found


def _matrix(column, kind=np.float32):
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def valid_vectors(vectors: DataFrame, key="vec_id", value="embedding") -> DataFrame:
    """``(vec_id, v, same)`` of rows with a finite, non-zero vector of the commonest length.

    ``v`` holds the numbers as bytes; ``same`` is equal for equal vectors.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"),
                          F.col(value).cast("array<double>").alias("e")).where("vec_id is not null")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0))
    usual = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("e") == (usual["n"] if usual else -1))

    def pack(batches):
        for batch in batches:
            values = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tobytes() for v in values], pa.binary())],
                names=["vec_id", "v"])

    return (rows.mapInArrow(pack, "vec_id bigint, v binary").distinct()
            .withColumn("same", F.md5("v")))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` best of each row: by score, then smaller id."""
    if scores.shape[1] > k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        keep = np.flatnonzero((scores >= edge).any(0))
        scores, ids = scores[:, keep], ids[keep]
    else:
        keep = np.arange(scores.shape[1])
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return keep[order]


def _calibrated(forest, counts, rows: DataFrame, probes: np.ndarray, k: int, recall: float) -> int:
    """Rows a query has to look at so that the probes find ``recall`` of their
    exact neighbours, which a scan of all rows by blocks gives."""
    def scan(batches):
        for batch in batches:
            vectors, ids = _matrix(batch.column(1), np.float64), batch.column(0).to_numpy()
            scores = probes @ vectors.T
            best = _best(scores, ids, k)
            probe = np.repeat(np.arange(len(scores)), best.shape[1])
            flat = best.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(probe), pa.array(scores[probe, flat]), pa.array(ids[flat]),
                 batch.column(1).take(pa.array(flat))], names=["probe", "score", "vec_id", "v"])

    near = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    true = (rows.select("vec_id", "v").mapInArrow(scan, "probe bigint, score double, vec_id bigint, v binary")
            .withColumn("n", F.row_number().over(near)).where(F.col("n") <= k)  # probes x k rows
            .toArrow())
    leaves = forest.assign(_matrix(true.column("v"), np.float64))
    margins, total = forest.margins(probes), sum(counts)
    needed = []
    for i in range(len(probes)):
        order = forest.search(margins[i], counts, total + 1)
        reached = np.zeros(forest.leaves, np.int64)
        reached[order] = np.cumsum([counts[leaf] for leaf in order]) - [counts[leaf] for leaf in order]
        mine = leaves[true.column("probe").to_numpy() == i]
        needed += reached[mine].min(1).tolist()
    # The budget is checked before a leaf is taken, so it must exceed what lies ahead.
    return int(np.quantile(needed, recall)) + 1


def nearest(vectors: DataFrame, is_query, k: int = 20, trees=TREES, leaves=LEAVES, recall=RECALL,
            key="vec_id", value="embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row of which ``is_query`` (a function of
    the id column) holds, the ``k`` nearest other rows found, by inner product in
    double precision; ties go to the smaller id.

    The forest is fitted on at most ``SAMPLE`` vectors, all rows are indexed. Equal
    vectors are searched and offered once: only their ``k + 1`` smallest ids can be
    among the nearest. Leaves are cut into blocks of about ``BLOCK`` rows and queries,
    so no leaf and no common vector meets in one task. The search goes on until
    a number of rows that gives probe queries ``recall``, and at least until ``k + 1``
    rows are sure. Rows without an id or with a null, zero, non-finite or oddly long
    vector take no part; repeated rows count once. No queries or candidates, no rows.
    """
    some = materialize(valid_vectors(vectors, key, value), "vectors")
    first = Window.partitionBy("same").orderBy("vec_id")
    rows = materialize(some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
                       .select("vec_id", "v"), "candidates")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not len(sample):
        return empty
    fitted = _matrix(sample.column("v"), np.float64)
    forest = Forest(fitted, trees, leaves)

    def assign(batches):
        for batch in batches:
            found = forest.assign(_matrix(batch.column(1), np.float64))
            at = pa.array(np.repeat(np.arange(len(batch)), found.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.ravel()), batch.column(0).take(at), batch.column(1).take(at)],
                names=["leaf", "vec_id", "v"])

    index = materialize(rows.mapInArrow(assign, "leaf int, vec_id bigint, v binary"), "index")
    counts = np.zeros(forest.leaves, np.int64)
    for leaf, n in index.groupBy("leaf").count().collect():  # trees x leaves rows
        counts[leaf] = n
    budget = max(_calibrated(forest, counts.tolist(), rows, fitted[:PROBES], k + 1, recall),
                 trees * (k + 1))
    held = counts.tolist()

    asked = some.where(is_query(F.col("vec_id")))
    distinct = asked.groupBy("same").agg(F.first("v").alias("v"))

    def route(batches):
        for batch in batches:
            margins = forest.margins(_matrix(batch.column(1), np.float64))
            found = [forest.search(m, held, budget) for m in margins]
            at = pa.array(np.repeat(np.arange(len(batch)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found), pa.int32()), batch.column(0).take(at),
                 batch.column(1).take(at)], names=["leaf", "same", "v"])

    routed = materialize(distinct.mapInArrow(route, "leaf int, same string, v binary"), "routed")
    cuts = np.ones(forest.leaves, np.int64)
    for leaf, n in routed.groupBy("leaf").count().collect():
        cuts[leaf] = -(-n // BLOCK)
    parts = np.maximum(1, -(-counts // BLOCK))

    def table(values):
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("leaf") + 1)

    left = (routed.withColumn("part", F.explode(F.sequence(F.lit(0), table(parts) - 1)))
            .withColumn("cut", F.pmod(F.xxhash64("same"), table(cuts)).cast("int")))
    right = (index.withColumn("part", F.pmod(F.xxhash64("vec_id"), table(parts)).cast("int"))
             .withColumn("cut", F.explode(F.sequence(F.lit(0), table(cuts) - 1))))

    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table({"same": pa.array([], pa.string()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        q = _matrix(queries.column("v").combine_chunks(), np.float64)
        v, ids = _matrix(rows.column("v").combine_chunks(), np.float64), rows.column("vec_id").to_numpy()
        best = _best(q @ v.T, ids, k + 1)
        asks = np.repeat(np.arange(len(q)), best.shape[1])
        flat = best.ravel()
        # The exact score of what is kept, always summed in the same order.
        score = (q[asks] * v[flat]).sum(1)
        return pa.table({"same": queries.column("same").take(pa.array(asks)), "vec_id": ids[flat],
                         "score": score})

    keys = ["leaf", "part", "cut"]
    met = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
           .applyInArrow(compare, "same string, vec_id bigint, score double"))
    order = Window.partitionBy("same").orderBy(F.desc("score"), "vec_id")
    found = materialize(
        met.groupBy("same", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"), "found")
    ranked = Window.partitionBy("query_id", "same").orderBy(F.desc("score"), "vec_id")
    return (asked.select(F.col("vec_id").alias("query_id"), "same").join(found, "same")
            .where(F.col("query_id") != F.col("vec_id"))
            .withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
