"""Order inside a series without ever needing a whole series in one task.

Everything that depends on time order reads ``pos`` (1-based) and ``n``. For
daily or coarser panels the calendar bounds a series, so a window per series is
safe. For finer panels a series may hold a large part of all rows: positions
then come from counts per (series, time chunk), and neighbours are looked up
inside blocks of fixed length that carry copies of their edge rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.calendar import is_bounded, time_chunk
from ..schema import ID, POS, SIZE, TIME

BLOCK_ROWS = 4096
# Chunk of rows without a time.
LAST_CHUNK = 2 ** 62


def with_positions(panel: DataFrame, freq: str | None = None,
                   id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """Add ``pos`` (1..n by time, missing times last) and ``n`` (rows of the series)."""
    # Rows of one time are ordered by their content, so that positions don't depend on
    # how the rows arrive.
    others = [F.col(c) for c in panel.columns if c not in (id_col, time_col)]
    by_time = [F.col(time_col).asc_nulls_last(), *([F.xxhash64(*others), *others] if others else [])]
    if is_bounded(freq):
        series = Window.partitionBy(id_col).orderBy(*by_time)
        whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return panel.select(
            "*",
            F.row_number().over(series).cast("long").alias(POS),
            F.count(F.lit(1)).over(whole).alias(SIZE))
    chunk = "_chunk"
    chunked = panel.withColumn(chunk, F.coalesce(
        time_chunk(F.col(time_col), freq, BLOCK_ROWS), F.lit(LAST_CHUNK)))
    # One row per (series, chunk): partial counts before the shuffle keep this small.
    counts = chunked.groupBy(id_col, chunk).agg(F.count(F.lit(1)).alias("_rows"))
    series = Window.partitionBy(id_col).orderBy(chunk)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(
        id_col, chunk,
        (F.sum("_rows").over(series) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(whole).alias(SIZE))
    inside = Window.partitionBy(id_col, chunk).orderBy(*by_time)
    return (
        chunked.withColumn("_row", F.row_number().over(inside))
        .join(starts, [id_col, chunk])
        .select(*panel.columns, (F.col("_before") + F.col("_row")).alias(POS), SIZE))


def series_sizes(panel: DataFrame, id_col: str = ID) -> DataFrame:
    """Rows per series, counted before the shuffle."""
    return panel.groupBy(id_col).agg(F.count(F.lit(1)).alias(SIZE))


@dataclass(frozen=True)
class Neighbours:
    """Rows with the window that sees up to ``before``/``after`` rows around each."""

    rows: DataFrame
    keys: list[str]
    core: Column

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(POS)

    def only_core(self, frame: DataFrame) -> DataFrame:
        """Drop the edge copies once the window results are in."""
        if "_block" not in self.keys:
            return frame
        return frame.filter(self.core).drop("_block", "_home")


def neighbours(positioned: DataFrame, freq: str | None, before: int = 0, after: int = 0,
               id_col: str = ID) -> Neighbours:
    """Prepare windows over a positioned panel.

    A bounded series is one window partition. Otherwise each row goes to the
    block of its position and, near a block edge, also to the neighbouring
    block, so ``before`` rows back and ``after`` rows ahead are always present.
    """
    if is_bounded(freq):
        return Neighbours(positioned, [id_col], F.lit(True))
    size = max(BLOCK_ROWS, before, after)
    home = F.floor((F.col(POS) - 1) / F.lit(size)).cast("long")
    offset = (F.col(POS) - 1) % F.lit(size)
    last_block = F.floor((F.col(SIZE) - 1) / F.lit(size)).cast("long")
    blocks = F.array_compact(F.array(
        home,
        F.when((offset >= size - before) & (home < last_block), home + 1),
        F.when((offset < after) & (home > 0), home - 1)))
    rows = positioned.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    return Neighbours(rows, [id_col, "_block"], F.col("_block") == F.col("_home"))
