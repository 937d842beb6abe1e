"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in ``target / size`` copies of its source. Documents are
ordered by size within their source, the expected copies are summed up along that order, one
random offset per source is added, and a document is emitted once for each integer that its
stretch of the sum crosses. Ordering by size spreads the copies evenly over long and short
documents, so the words taken come near the target, not only the number of documents.

The running sum is distributed: rows are dealt by ranges of (source, size, doc_id), which splits
a hot source over many tasks, and stored with their place in the task. What stands before a
task's first row of a source comes from one count per task and source.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from brackenlog.llm.tokens import releasing
from brackenlog.session import fresh_dir, shuffle_width

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = 20


def n_words(text: str = "text") -> Column:
    """Number of words of a column, natively; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, docs, target`` from ``source, source_size, docs``, one row per source.

    Sources in code-point order, null last, take the weights in turn. A source's target is its
    weight times a common level, and ``most`` times its size if that is less; the level is the one
    at which all targets add up to all sizes. Sources fill up in the order of size over weight, so
    the level follows from running sums.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    rows = rows.withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    up = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("all", F.sum("source_size").over(every))
    # The level if all sources before this one are full and this one and those after are not.
    rows = rows.withColumn("level", (F.col("all") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    rows = rows.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every))
    target = F.least(most * F.col("source_size"), F.col("weight") * F.coalesce(F.col("level"), F.lit(0.0)))
    return rows.select("source", "source_size", "docs", target.cast("double").alias("target"))


@releasing
def _placed(batches):
    """Adds the place of each row in its task, counted apart for each source."""
    from pyspark import TaskContext

    task, last, place = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        places = []
        for source in batch.column("_source").to_pylist():
            place = place + 1 if source == last else 0
            last = source
            places.append(place)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * n, pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "_task", "_place"])


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = SEED, size: Column | None = None) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``, one row per row of ``docs``.

    ``size`` is the number of words of ``text`` unless it is given. The result depends on the
    rows and ``seed`` only, not on how they are dealt.

    Defined cases: a null or empty text has size 0 and may be emitted, which takes no word. Null
    sources form one source, the last. Rows that repeat a doc_id are documents of their own. A
    source without words has target 0. Columns named like the new ones are replaced. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    new = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in new]
    given = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)), F.col("source").alias("_source"), F.col("doc_id").alias("_id"), (n_words() if size is None else size.cast("long")).alias("_size"))
    # A digest of the text stands for it in the order, so that rows with one id keep their order.
    given = given.withColumn("_tie", F.xxhash64(*(F.col(f"_c{i}") for i in range(len(kept)))))
    key = ["_source", "_size", "_id", "_tie"]
    dealt = given.repartitionByRange(shuffle_width(spark), *key).sortWithinPartitions(*key)
    shape = StructType([*dealt.schema.fields, StructField("_task", IntegerType()), StructField("_place", LongType())])
    placed = dealt.mapInArrow(_placed, shape)
    folder = fresh_dir(spark, "mix")
    placed.write.parquet(folder)
    stored = spark.read.parquet(folder)
    counts = stored.groupBy("_source", "_task").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("words"))
    earlier = Window.partitionBy("_source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    sources = targets(counts.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size"), F.sum("n").alias("docs")), weights, most)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("\x00null"))), F.lit(1 << 40)) / float(1 << 40)
    sources = sources.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("offset", offset)
    steps = counts.join(sources, F.col("_source").eqNullSafe(F.col("source"))).select(F.col("_source").alias("_s"), F.col("_task").alias("_t"), "_before", "source_size", "target", "rate", "offset")
    rows = stored.join(steps, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t")))
    place = F.col("_before") + F.col("_place")
    crossed = F.floor((place + 1) * F.col("rate") + F.col("offset")) - F.floor(place * F.col("rate") + F.col("offset"))
    # Rounding of a sum far out must not lift a document above the bound.
    rows = rows.withColumn("copies", F.least(F.ceil(F.col("rate")), crossed).cast("long"))
    return rows.select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)),
        F.col("_size").alias("size"),
        F.col("source_size").cast("long"),
        "target",
        "copies",
        (F.col("copies") * F.col("_size")).alias("taken"),
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix`` once for each of its copies, with its own columns only."""
    own = [c for c in mixed.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(f"`{c}`" for c in own))
