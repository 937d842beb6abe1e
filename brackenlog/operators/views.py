"""Views over entries: union, time merge, context, match numbers, first rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from brackenlog.operators.blocks import dense_position, forward_fill, global_position, near_match


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack sources; their order here breaks ties in a merge."""
    numbered = [df.withColumn("source_ord", F.lit(i)) for i, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def merge_order() -> list[Column]:
    return [F.col("merge_time").asc_nulls_first(), F.col("source_ord").asc(), F.col("entry_index").asc()]


def merge_times(df: DataFrame, order: str = "entry_index") -> DataFrame:
    """Sort time of every entry: its own, else the last one known in its source, else the
    first one known; null for a source without any time, which sorts ahead of all."""
    return forward_fill(df, "ts", order, name="merge_time")


def merge_sources(df: DataFrame, numbered: bool = True) -> DataFrame:
    """Interleave sources by time. ``df`` holds ``source, source_ord, entry_index, ts``.

    With ``numbered`` every entry gets its position in the merge, which costs one write of
    the merged rows; otherwise the result is lazy and merely sorted.
    """
    timed = merge_times(df)
    return global_position(timed, merge_order()) if numbered else timed.orderBy(*merge_order())


def context_rows(
    df: DataFrame, is_match: str, n: int, order: str = "entry_index", source: str = "source"
) -> DataFrame:
    """Matches and the ``n`` rows around each. With ``n`` 0 the view keeps all its rows."""
    return df if n == 0 else near_match(df, is_match, n, order, source)


def match_ordinals(matches: DataFrame, order: str = "entry_index", source: str = "source") -> DataFrame:
    """``ordinal`` of each match within its source, and the ``total`` there."""
    numbered = dense_position(matches, order, source, name="ordinal")
    totals = matches.groupBy(source).agg(F.count(F.lit(1)).alias("total"))
    return numbered.withColumn("ordinal", F.col("ordinal") + 1).join(totals, source)


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows of a view, in order."""
    return df.orderBy(*order).limit(n)
