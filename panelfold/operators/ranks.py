"""Exact global ranks that no single task has to compute."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import ID

# Hex digits of the digest that name a bucket: 16^3 = 4096 buckets per group.
BUCKET_DIGITS = 3


def hash_rank(rows: DataFrame, digest: Column, groups: list[str] | None = None,
              id_col: str = ID) -> DataFrame:
    """Add ``rank`` (1-based order of ``digest`` in its group) and ``total``.

    A global ``row_number`` would sort everything in one task. Digests are
    uniform, so their first digits cut each group into equal buckets: rows are
    numbered inside a bucket and shifted by the running count of the buckets
    before it. The table of counts has 4096 rows per group, whatever the data.
    """
    groups = groups or []
    keyed = rows.withColumn("_digest", digest)
    keyed = keyed.withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
    counts = keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # Running sum over at most 4096 rows per group.
    running = Window.partitionBy(*groups, F.lit(0)).orderBy("_bucket")
    whole = running.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(
        *groups, "_bucket",
        (F.sum("_rows").over(running) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(whole).alias("total"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_digest", id_col)
    return (
        keyed.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(starts), [*groups, "_bucket"])
        .select(*rows.columns, (F.col("_before") + F.col("_row")).alias("rank"), "total"))
