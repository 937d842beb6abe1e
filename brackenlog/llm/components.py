"""Connected components of links, with every node's smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brackenlog.session import fresh_dir

MOST_ROUNDS = 60


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read again, which cuts its lineage."""
    folder = fresh_dir(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b`` of longs); loops are ignored.

    Alternates two star operations until nothing changes: each node's larger neighbours, then
    its smaller ones, are tied to its smallest neighbour. The number of rounds grows with the
    logarithm of the longest path. Minima aggregate before the shuffle, and the joins carry no
    hint, so Spark splits the rows of a node with very many links.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        # All stars: no node is both an end and a centre, and each end has one centre.
        settled = after.select("v").distinct().join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty()
        edges = after
        if settled:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
