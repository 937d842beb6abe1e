"""Running computations over a long ordered source without one task per source.

A source is cut into blocks of consecutive order values. Windows run inside a block; what
a block needs from its neighbours is computed from one summary row per block. A block
holds at most ``BLOCK`` rows, however many rows its source has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brackenlog.session import fresh_dir, shuffle_width

BLOCK = 1 << 18


def with_block(df: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("long"))


def in_block(source: str, order: str):
    return Window.partitionBy(source, "_block").orderBy(order)


def over_blocks(source: str):
    return Window.partitionBy(source).orderBy("_block")


def _before(source: str):
    return over_blocks(source).rowsBetween(Window.unboundedPreceding, -1)


def _after(source: str):
    # Frames that reach to the end cost quadratic time in Spark; the reverse order does not.
    return Window.partitionBy(source).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)


def carried(df: DataFrame, carry: DataFrame, source: str) -> DataFrame:
    """Join per-block carries; sources of a single block have none."""
    return df.join(carry, [source, "_block"], "left")


def _several(summary: DataFrame, source: str) -> DataFrame:
    """Summaries of sources with more than one block: the only ones that need a carry."""
    return summary.withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(source))).filter(
        "_blocks > 1"
    )


def dense_position(
    df: DataFrame, order: str, source: str = "source", name: str = "position", block: int = BLOCK
) -> DataFrame:
    """0-based position of every row within its source."""
    df = with_block(df, order, block)
    summary = df.groupBy(source, "_block").agg(F.count(F.lit(1)).alias("_n"))
    carry = _several(summary, source).select(
        source, "_block", F.coalesce(F.sum("_n").over(_before(source)), F.lit(0)).alias("_base")
    )
    here = F.row_number().over(in_block(source, order)).cast("long") - 1
    return (
        carried(df, carry, source)
        .withColumn(name, here + F.coalesce("_base", F.lit(0)))
        .drop("_block", "_base")
    )


def forward_fill(
    df: DataFrame, value: str, order: str, source: str = "source", name: str = "filled", block: int = BLOCK
) -> DataFrame:
    """Last known value of the source so far; rows before the first known one take that."""
    df = with_block(df, order, block)
    known = F.col(value).isNotNull()
    blocks = df.groupBy(source, "_block").agg(
        F.min_by(F.when(known, F.col(value)), F.when(known, F.col(order))).alias("_first"),
        F.max_by(F.when(known, F.col(value)), F.when(known, F.col(order))).alias("_last"),
    )
    carry = _several(blocks, source).select(
        source,
        "_block",
        F.coalesce(
            F.last("_last", ignorenulls=True).over(_before(source)),
            F.first("_first", ignorenulls=True).over(
                over_blocks(source).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        ).alias("_carry"),
    )
    window = in_block(source, order)
    so_far = F.last(value, ignorenulls=True).over(
        window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    first = F.first(value, ignorenulls=True).over(
        window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        carried(df, carry, source)
        .withColumn(name, F.coalesce(so_far, "_carry", first))
        .drop("_block", "_carry")
    )


def near_match(
    df: DataFrame,
    is_match: str,
    n: int,
    order: str,
    source: str = "source",
    block: int = BLOCK,
) -> DataFrame:
    """Rows with a match at most ``n`` rows away in their source.

    Works on distances to the previous and the next match, so neither a halo of copied
    rows nor a join of the source with itself is needed.
    """
    df = with_block(df, order, block)
    row = F.row_number().over(in_block(source, order)).cast("long")
    at = F.when(F.col(is_match), row)
    summary = (
        df.select(source, "_block", order, is_match)
        .withColumn("_at", at)
        .groupBy(source, "_block")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    )
    base = F.coalesce(F.sum("_n").over(_before(source)), F.lit(0))
    based = _several(summary, source).withColumn("_base", base)
    carry = based.select(
        source,
        "_block",
        "_base",
        F.max(F.col("_last") + F.col("_base")).over(_before(source)).alias("_prev"),
        F.min(F.col("_first") + F.col("_base")).over(_after(source)).alias("_next"),
    )
    placed = (
        carried(df, carry, source)
        .withColumn("_pos", row + F.coalesce("_base", F.lit(0)))
        .withColumn("_at", F.when(F.col(is_match), F.col("_pos")))
    )
    up = in_block(source, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backwards = Window.partitionBy(source, "_block").orderBy(F.desc(order))
    down = backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = F.col("_pos") - F.coalesce(F.max("_at").over(up), "_prev")
    ahead = F.coalesce(F.min("_at").over(down), "_next") - F.col("_pos")
    close = F.coalesce(back <= n, F.lit(False)) | F.coalesce(ahead <= n, F.lit(False))
    return (
        placed.withColumn("_close", close)
        .filter("_close")
        .drop("_block", "_base", "_prev", "_next", "_pos", "_at", "_close")
    )


def global_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """0-based position of every row in a total order over all sources.

    The rows are range-partitioned, sorted and written to the shared checkpoint folder with
    their place in the partition; the offsets of the partitions are one row each.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    folder = fresh_dir(spark, "ordered")
    ranged.withColumn("_place", F.monotonically_increasing_id()).write.parquet(folder)
    placed = spark.read.parquet(folder)
    part = F.shiftright("_place", 33).cast("int").alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition, so both the window and the broadcast are bounded.
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_base", "_place")
    )
