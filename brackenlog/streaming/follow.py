"""Following growing files: schemas found, lines folded and entries kept, batch by batch.

Each batch is folded by the operators of the batch library, so the lines of one source are split
over tasks like any others. What a batch hands to the next is one row per source: its schemas,
how many lines and entries it has had, and the text of its open entry, which the next batch
folds as one line before its own.

Everything is written below one folder, by batch number: ``entries/batch=N`` holds the entries a
batch closed, ``state/batch=N`` the sources after it. A batch that is run again reads the state
before it and writes the same again, so replays change nothing, and the entries of a folder are
its closed ones and the open ones of the last state: nothing is compared or read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from brackenlog.operators.detect import detect_schemas, schema_sets
from brackenlog.operators.extract import parse, with_fields
from brackenlog.operators.fold import _summary, flagged_lines, fold_flagged, split_ends
from brackenlog.plans.builtin import ALL_SCHEMAS, BRACKETED
from brackenlog.plans.schema import LogSchema
from brackenlog.session import stored
from brackenlog.sources.files import head_sample

STATE = "source string, schemas array<string>, next_line long, next_index long, open_lines long, open_raw string"
ENTRIES = "source string, entry_index long, line_no long, raw string"
#: Sources, at a few hundred bytes each, whose schemas and counts may be broadcast.
MOST_SOURCES = 200_000


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    # A folder without its mark of success is a batch that was cut off.
    done = [n for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/{n}/_SUCCESS"))]
    return sorted(int(n[6:]) for n in done)


def followed_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The sources after the last batch, or after the last one before a given batch."""
    found = [v for v in _versions(spark, folder) if before is None or v < before]
    if not found:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{folder}/state/batch={found[-1]}")


def _few(df: DataFrame) -> DataFrame:
    """A frame of one row per source, broadcast where it is counted to be small."""
    return F.broadcast(df) if df.count() <= MOST_SOURCES else df


def fold_batch(
    lines: DataFrame, folder: str, batch: int, candidates: Sequence[LogSchema] = ALL_SCHEMAS, default: LogSchema = BRACKETED
) -> None:
    """Fold one batch of ``source, split, pos, value``; lines of a split together and in order.

    Sources that have no schemas yet get theirs from their first lines. A batch without lines
    leaves the state as it is.
    """
    spark = lines.sparkSession
    lines = lines.select("source", "split", "pos", "value").persist(StorageLevel.DISK_ONLY)
    try:
        _fold_batch(spark, lines, folder, batch, candidates, default)
    finally:
        lines.unpersist()


def _fold_batch(spark, lines, folder, batch, candidates, default) -> None:
    known = list({s.name: s for s in [*candidates, default]}.values())
    before = followed_state(spark, folder, batch)
    present = lines.groupBy("source").agg(F.min("split").alias("_at"))
    present = stored(present.join(before, "source", "left"), "sources")
    new = present.where("schemas IS NULL").select("source")
    if new.isEmpty():
        assigned = present.select("source", "schemas")
    else:
        sample = head_sample(lines.join(_few(new), "source", "left_semi")).select("source", "line_no", "value")
        found = detect_schemas(sample, candidates, default)
        assigned = stored(present.where("schemas IS NOT NULL").select("source", "schemas").unionByName(found), "assigned")
    numbered, sets = schema_sets(assigned, known)
    used = sorted({i for order in sets for i in order})
    sets = [[used.index(i) for i in order] for order in sets]
    known = [known[i] for i in used]
    if not sets:
        return
    if len(sets) == 1:
        given = lines.withColumn("schema_set", F.lit(0))
    else:
        given = lines.join(_few(numbered), "source")
    flagged = flagged_lines(given, known, sets)

    # The open entry of a source is one line before the batch, that starts and stays open.
    held = present.where("open_raw IS NOT NULL").join(numbered, "source")
    held = held.select("source", "schema_set", F.lit(-1).cast("long").alias("split"), (-F.col("open_lines")).alias("pos"), F.col("open_raw").alias("value"))
    held = held.withColumns({"_st": F.lit(True), "_en": F.lit(False), "_skip": F.lit(False)})
    flagged = flagged.select(*held.columns).unionByName(held)

    # What the source has had before stands in the summary as one more split.
    past = present.where("schemas IS NOT NULL").select(
        "source",
        F.lit(-2).cast("long").alias("split"),
        (F.col("next_line") - F.when(F.col("open_raw").isNull(), 1).otherwise(2)).alias("_n"),
        F.lit(False).alias("_leaves"),
        F.col("next_index").alias("_new_open"),
        F.col("next_index").alias("_new_shut"),
    )
    summary = stored(_summary(flagged, scanned=True).unionByName(past, allowMissingColumns=True), "splits")
    entries = fold_flagged(flagged, summary, folded_lines=True)

    after = split_ends(summary).select(
        "source",
        F.col("_lines").alias("lines"),
        (F.col("_entries") - F.col("_open").cast("long")).alias("closed"),
        F.col("_open").alias("open"),
    )
    after = stored(after.join(assigned, "source"), "after")
    last = F.col("open") & (F.col("entry_index") == F.col("closed"))
    told = entries.join(_few(after), "source").select("source", "entry_index", "line_no", "raw", last.alias("open"))
    told.write.mode("overwrite").partitionBy("open").parquet(f"{folder}/entries/batch={batch}")

    written = spark.read.schema(f"{ENTRIES}, open boolean").parquet(f"{folder}/entries/batch={batch}").where("open")
    rows = after.join(written.select("source", "line_no", "raw"), "source", "left")
    rows = rows.select(
        "source",
        "schemas",
        (F.col("lines") + 1).alias("next_line"),
        F.col("closed").alias("next_index"),
        F.when(F.col("open"), F.col("lines") + 1 - F.col("line_no")).alias("open_lines"),
        F.when(F.col("open"), F.col("raw")).alias("open_raw"),
    )
    kept = before.join(present.select("source"), "source", "left_anti").select(*rows.columns)
    rows.unionByName(kept).write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")
    _forget(spark, folder, batch)


def _forget(spark: SparkSession, folder: str, batch: int) -> None:
    """Remove states that no replay can need: a replay reads that before its batch."""
    old = [v for v in _versions(spark, folder) if v < batch][:-1]
    for version in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/batch={version}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def follow(
    lines: DataFrame, folder: str, checkpoint: str, candidates: Sequence[LogSchema] = ALL_SCHEMAS, every: str | None = None
) -> StreamingQuery:
    """Start folding a stream of lines into a folder; without ``every`` it takes what is there and ends."""
    writer = lines.writeStream.foreachBatch(lambda df, batch: fold_batch(df, folder, batch, candidates))
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def followed_entries(spark: SparkSession, folder: str) -> DataFrame:
    """All entries so far, ``source, entry_index, line_no, raw, provisional``: the closed ones, and
    the open entry of each source as provisional."""
    state = followed_state(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/entries")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    closed = spark.createDataFrame([], ENTRIES)
    if fs.exists(path):
        # Batches after the last state were cut off and will be written again.
        done = _versions(spark, folder)
        closed = spark.read.schema(f"{ENTRIES}, batch long, open boolean").parquet(f"{folder}/entries")
        closed = closed.where(~F.col("open") & (F.col("batch") <= (done[-1] if done else -1))).select("source", "entry_index", "line_no", "raw")
    still = state.where("open_raw IS NOT NULL").select(
        "source", F.col("next_index").alias("entry_index"), (F.col("next_line") - F.col("open_lines")).alias("line_no"), F.col("open_raw").alias("raw")
    )
    return closed.withColumn("provisional", F.lit(False)).unionByName(still.withColumn("provisional", F.lit(True)))


def open_followed(spark: SparkSession, folder: str, candidates: Sequence[LogSchema] = ALL_SCHEMAS) -> DataFrame:
    """The entries so far with their fields, each source under the schemas it was found to have."""
    known = list({s.name: s for s in [*candidates, BRACKETED]}.values())
    numbered, sets = schema_sets(followed_state(spark, folder).select("source", "schemas"), known)
    used = sorted({i for order in sets for i in order})
    entries = followed_entries(spark, folder).join(_few(numbered), "source")
    if not sets:
        sets, used = [[0]], [0]
    parsed = parse(entries, [known[i] for i in used], [[used.index(i) for i in order] for order in sets])
    return with_fields(parsed, known)
