"""Logs that are still being written.

A collector spools each source as segments, ``<spool>/<source>/<segment>``; a segment is
complete once it appears. Field extraction, rules and searches are stateless and run on
these streams unchanged. Only folding lines into entries keeps state.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brackenlog.functions.text import trim_line_end
from brackenlog.operators.detect import detect_schemas
from brackenlog.operators.extract import Schemas, as_list
from brackenlog.operators.fold import _flags
from brackenlog.plans.builtin import ALL_SCHEMAS, BRACKETED
from brackenlog.plans.schema import LogSchema
from brackenlog.sources.files import SAMPLE_LINES, read_heads

ENTRY_SCHEMA = (
    "source string, entry_index long, line_no long, raw string, provisional boolean, first boolean, late_segment string"
)
_STATE = (
    "is_open boolean, head_line long, raw string, next_line long, next_index long, last_segment string, emitted boolean"
)


def spool_lines(
    spark: SparkSession,
    spool: str,
    stream: bool = True,
    segments_per_batch: int | None = None,
    bytes_per_batch: int | None = None,
) -> DataFrame:
    """Lines ``source, segment, pos, value`` of spooled segments, as a stream or a batch.

    A segment is read whole, because its lines have no other order; the collector's
    rotation size bounds it. A batch takes all segments that are there, in whatever order they
    were written. With ``segments_per_batch`` or ``bytes_per_batch`` (not both) it takes the oldest
    by modification time, so each source's segments must have been written in the order of their
    names; one that comes after a later one is reported by ``fold_stream``, which holds a batch of
    a source in memory.
    """
    reader = spark.readStream if stream else spark.read
    if stream and segments_per_batch:
        reader = reader.option("maxFilesPerTrigger", segments_per_batch)
    if stream and bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    path = F.col("_metadata.file_path")
    whole = reader.option("wholetext", "true").option("recursiveFileLookup", "true").text(spool).select(
        F.element_at(F.split(path, "/"), -2).alias("source"),
        F.element_at(F.split(path, "/"), -1).alias("segment"),
        # The line feed that ends a segment starts no further line.
        F.regexp_replace("value", r"\n\z", "").alias("text"),
    )
    lines = whole.select("source", "segment", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("source", "segment", "pos", trim_line_end(F.col("line")).alias("value"))


def fold_stream(
    lines: DataFrame,
    schemas: Schemas = (),
    provisional: str = "batch",
    quiet_ms: int = 5000,
    sets: Sequence[Sequence[int]] | None = None,
) -> DataFrame:
    """Entries of a line stream. The open entry of each source stays in state.

    Its text so far is emitted with ``provisional`` set: after every batch in which it grew, or
    (with ``"timeout"``) once when the source has been quiet for ``quiet_ms``; ``"never"`` waits
    for the line that closes it. A sink keeps the last row per ``(source, entry_index)``;
    ``first`` marks the first row of an entry, so counting those counts each entry once.

    With ``sets``, an int column ``schema_set`` picks the schemas of a line's source.

    Lines fold in the order of segment names. A segment that arrives after a later one of its
    source was folded is not appended: a row with its name in ``late_segment`` and no entry
    reports it.
    """
    if provisional not in ("batch", "timeout", "never"):
        raise ValueError("provisional is batch, timeout or never")
    timed = provisional == "timeout"

    def run(key, frames, state: GroupState):
        *opened, folded, emitted = list(state.get) if state.exists else [False, 0, "", 1, 0, None, False]
        if state.hasTimedOut:
            # Updating the state also clears the timeout: nothing more until a line arrives.
            state.update((*opened, folded, True))
            if opened[0]:
                yield _provisional(key[0], opened, not emitted)
            return
        frame = pd.concat(list(frames), ignore_index=True)
        if folded is not None:
            late = frame["segment"] <= folded
            if late.any():
                yield _late(key[0], sorted(frame["segment"][late].unique()))
                frame = frame[~late]
        if len(frame):
            frame = frame.sort_values(["segment", "pos"])
            before = opened
            closed, opened = _advance(key[0], frame, opened)
            # Only an entry that was open before this batch can have been emitted already.
            closed["first"] = ~((closed["entry_index"] == before[4]) & emitted)
            same = opened[0] and before[0] and opened[4] == before[4]
            emitted = emitted and same
            folded = frame["segment"].iloc[-1]
            yield closed
            if provisional == "batch" and opened[0] and not (same and opened[2] == before[2]):
                yield _provisional(key[0], opened, not emitted)
                emitted = True
        state.update((*opened, folded, emitted))
        if timed and opened[0]:
            state.setTimeoutDuration(quiet_ms)

    groups = [as_list(schemas)] if sets is None else [[as_list(schemas)[i] for i in order] for order in sets]
    flagged = lines.withColumns(_flags(groups, F.lit(0) if sets is None else F.col("schema_set")))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return flagged.groupBy("source").applyInPandasWithState(run, ENTRY_SCHEMA, _STATE, "append", timeout)


def _provisional(source: str, opened: list, first: bool) -> pd.DataFrame:
    return _rows(source, [opened[4]], [opened[1]], [opened[2]], True).assign(first=first)


def _late(source: str, segments: list[str]) -> pd.DataFrame:
    nothing = pd.array([pd.NA] * len(segments), "Int64")
    return _rows(source, nothing, nothing, None, False).assign(first=False, late_segment=segments)


def _rows(source, index, line_no, raw, provisional) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "source": source,
            "entry_index": index,
            "line_no": line_no,
            "raw": raw,
            "provisional": provisional,
            "first": True,
            "late_segment": None,
        }
    )


def _advance(source: str, frame: pd.DataFrame, opened: list) -> tuple[pd.DataFrame, list]:
    """Entries a batch closes, and the entry it leaves open."""
    is_open, head_line, raw, next_line, next_index = opened
    start, end, skip = (frame[c].to_numpy(dtype=bool) for c in ("_st", "_en", "_skip"))
    size = len(frame)
    # What each line leaves behind, carried over lines that change nothing.
    decides = ~skip | end
    last = np.maximum.accumulate(np.where(decides, np.arange(size), -1))
    after = np.where(last >= 0, ~end[last] & ~skip[last], is_open)
    before = np.concatenate([[is_open], after[:-1]])
    begins = (~before & ~skip) | (before & start)
    kept = ~(skip & ~before)
    entry = np.cumsum(begins)[kept]
    text = frame["value"].to_numpy()[kept]
    joined = pd.Series(text).groupby(entry).agg("\n".join)
    heads = next_line + np.flatnonzero(begins)

    raws, lines = list(joined), list(heads)
    if is_open:
        continues = len(entry) > 0 and entry[0] == 0
        raws = [raw + "\n" + raws[0], *raws[1:]] if continues else [raw, *raws]
        lines = [head_line, *lines]
    still_open = bool(after[-1]) if size else is_open
    final = len(raws) - still_open
    closed = _rows(source, range(next_index, next_index + final), lines[:final], raws[:final], False)
    last_raw, last_head = (raws[-1], int(lines[-1])) if still_open else ("", 0)
    return closed, [still_open, last_head, last_raw, int(next_line + size), int(next_index + final)]


def settled(rows: DataFrame) -> DataFrame:
    """One row per entry out of everything a sink received: the final, else the longest."""
    return (
        rows.filter("late_segment IS NULL")
        .groupBy("source", "entry_index")
        .agg(
            F.max_by(
                F.struct("line_no", "raw", "provisional"),
                F.struct((~F.col("provisional")).alias("final"), F.length("raw").alias("length")),
            ).alias("e")
        )
        .select("source", "entry_index", "e.line_no", "e.raw", "e.provisional")
    )


def detect_segments(
    spark: SparkSession, spool: str, candidates: Sequence[LogSchema] = ALL_SCHEMAS
) -> DataFrame:
    """``source, schemas`` of live sources, from the first segment each has spooled.

    Run it once the first batch is captured, then start the stream with the schemas found.
    """
    # Names only: the reader prunes the content, and each source's first segment is opened once.
    path = F.col("_metadata.file_path")
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(spool)
    first = names.groupBy(F.element_at(F.split(path, "/"), -2).alias("name")).agg(F.min(path).alias("source"))
    heads = read_heads(spark, first.select("source"), SAMPLE_LINES)
    sample = heads.join(first, "source").select(F.col("name").alias("source"), "line_no", "value")
    return detect_schemas(sample, candidates, default=BRACKETED)


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Process everything spooled so far into Parquet and read it back."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def live_timeline(df: DataFrame, key: Column, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Entries per time window and key; entries later than ``late`` are dropped.

    A watermark needs a zoned timestamp; with the session in UTC the wall clock is kept.
    """
    timed = df.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    window = F.window("_at", width, slide) if slide else F.window("_at", width)
    return (
        timed.groupBy(window.alias("_w"), key.alias("key"))
        .agg(F.count(F.lit(1)).alias("entries"))
        .select(F.col("_w.start").cast("timestamp_ntz").alias("start"), "key", "entries")
    )
