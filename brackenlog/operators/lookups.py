"""Joins of entries with bookmarks and source metadata.

No side is broadcast by force: both tables may be large, and Spark broadcasts the one
whose measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_bookmarks(entries: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Bookmarked entries, found by source and physical line."""
    return entries.join(bookmarks, ["source", "line_no"])


def prune_bookmarks(bookmarks: DataFrame, sources: DataFrame) -> DataFrame:
    """Bookmarks whose source is still there."""
    return bookmarks.join(sources.select("source").distinct(), "source", "left_semi")


def with_source_info(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Label, description, tag and the like onto entries; unknown sources keep nulls."""
    return entries.join(sources, "source", "left")
