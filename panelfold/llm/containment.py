"""Benchmark decontamination: size-partitioned MinHash containment search."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelfold.llm.rows import narrow, widen
from panelfold.llm.textscan import Shingles, as_bytes, pieces
from panelfold.session import materialize

WIDTH = 5
THRESHOLD = 0.8
# The filter that travels to the executors has 16 bits a shingle, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27

_ITEM = "item_id bigint, n_shingles int, sketch boolean, hash bigint, shingle string"


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Bottom-k size for items of ``n`` shingles, from the upper end of their class.

    Classes are [2**p, 2**(p+1)). A document with at least ``threshold`` of ``n``
    shingles lacks at most ``floor((1 - threshold) * n)``, so it holds one of any
    k that exceed this: no item is missed.
    """
    upper = 2 ** int(n).bit_length() - 1
    return min(n, int(np.floor((1 - threshold) * upper + 1e-9)) + 1)


def item_shingles(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct shingles of every item; ``sketch`` marks its smallest hashes."""
    def run(batches):
        for batch in pieces(batches):
            ids = batch.column(0).to_pylist()
            found = Shingles(as_bytes(batch.column(1)), width)
            rows = []
            for row in np.unique(found.row):
                at = np.flatnonzero(found.row == row)
                _, first = np.unique(found.hash[at], return_index=True)
                k = sketch_size(len(first), threshold)
                rows += [(ids[row], len(first), rank < k, int(found.hash[at[i]].view(np.int64)),
                          found.text(at[i])) for rank, i in enumerate(first)]
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["item_id", "n_shingles", "sketch", "hash", "shingle"])

    items = items.where("item_id is not null").select(F.col("item_id").cast("bigint"), "text")
    return items.mapInArrow(run, _ITEM)


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """One bit per hash, in at most ``bits`` / 64 rows that reach the driver."""
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    rows = (hashes.groupBy(F.shiftright(place, 6).alias("w"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {bits - 1}) & 63 as int))")).alias("b"))
            .toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint8)


def shared_shingles(docs: DataFrame, shingles: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, text_hash, shingle)`` of documents that hold a sketched shingle."""
    count = shingles.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))
    context = docs.sparkSession.sparkContext
    filters = context.broadcast((_bitmap(shingles.where("sketch"), bits), _bitmap(shingles, bits)))

    def holds(bitmap, place):
        return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0

    def run(batches):
        sketch, every = filters.value
        for batch in pieces(batches):
            found = Shingles(as_bytes(batch.column(2)), width)
            place = found.hash & np.uint64(bits - 1)
            hit = np.zeros(len(batch), bool)
            hit[found.row[holds(sketch, place)]] = True
            at = np.flatnonzero(hit[found.row])
            at = at[holds(every, place[at])]
            if not len(at):
                continue
            pair = np.stack([found.row[at].astype(np.uint64), found.hash[at]], 1)
            _, first = np.unique(pair, axis=0, return_index=True)
            at = at[first]
            rows = pa.array(found.row[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array([found.text(i) for i in at], pa.string())],
                names=["doc_id", "text_hash", "shingle"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, shingle string")


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                    threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, text_hash, item_id, n_shingles, shared, containment)``: the items
    of which a document holds at least ``threshold`` of the distinct shingles.

    Words are runs of ASCII letters, digits and non-ASCII characters in lower
    case. Items fall into classes by size; the class sets how many of an item's
    smallest hashes a document is searched for. Documents that hold one are verified
    by exact comparison of shingle texts. An item of fewer than ``width`` words is
    one shingle, found in documents of the same words only. Null and wordless texts
    and items without an id match nothing; rows with equal doc_id and text count as
    one document; rows of one item_id count each on their own shingles' total, the
    largest. Empty tables give no rows.
    """
    shingles = materialize(item_shingles(items, width, threshold), "item_shingles")
    hits = shared_shingles(docs, shingles, width).distinct()
    wanted = shingles.groupBy("item_id", "shingle").agg(F.max("n_shingles").alias("n_shingles"))
    return (hits.join(wanted, "shingle")
            .groupBy("doc_id", "text_hash", "item_id")
            .agg(F.max("n_shingles").alias("n_shingles"), F.count("*").cast("int").alias("shared"))
            .withColumn("containment", F.col("shared") / F.col("n_shingles"))
            .where(F.col("shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9)))


def without_items(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                  threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain none of the items, with all their columns."""
    found = contained_items(docs, items, width, threshold)
    bad = materialize(found.select(F.col("doc_id").alias("_bad"),
                                   F.col("text_hash").alias("_bad_text")).distinct(), "contained")
    rows = narrow(docs, "doc_id", "text")
    clean = rows.join(bad, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_bad"))
                      & (F.xxhash64("text") == F.col("_bad_text")), "left_anti")
    return widen(clean, docs.columns, "doc_id", "text")
