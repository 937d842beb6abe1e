import random
import uuid

import pytest
from models import fold
from pyspark.sql import functions as F

from brackenlog.operators.extract import Lookup, parse
from brackenlog.plans.builtin import BRACKETED, GENERIC
from brackenlog.plans.schema import LogSchema
from brackenlog.streaming import live

START = LogSchema("start", "<a> <b>", entry_start=r"^S")
BOTH = LogSchema("both", "<a> <b>", entry_start=r"^\{", entry_end=r"^\}")
WORDS = ["", " ", "S one", "x", "k: v", "{", "}", "a b"]


def spool(folder, logs, cuts, rng):
    for source, lines in logs.items():
        (folder / source).mkdir(parents=True)
        at = 0
        for n in range(cuts):
            end = len(lines) if n == cuts - 1 else rng.randint(at, len(lines))
            if end > at:
                (folder / source / f"{n:04d}.log").write_text("\n".join(lines[at:end]) + "\n")
            at = end


@pytest.mark.parametrize("schemas,starts,ends,explicit", [
    ([START], [r"^S"], [], True), ([BOTH], [r"^\{"], [r"^\}"], True), ([GENERIC], [""], [], False)])
def test_stream_fold_equals_the_batch_model(spark, tmp_path, schemas, starts, ends, explicit):
    rng = random.Random(4)
    logs = {f"s{i}": rng.choices(WORDS, k=rng.randint(3, 15)) for i in range(6)}
    logs = {s: lines + ["S end"] for s, lines in logs.items()}
    spool(tmp_path / "spool", logs, 3, rng)
    # Few segments per batch, so that entries stay open across batches.
    lines = live.spool_lines(spark, str(tmp_path / "spool"), segments_per_batch=2)
    rows = live.run_to_folder(live.fold_stream(lines, schemas), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {}
    for r in live.settled(rows).collect():
        got.setdefault(r.source, []).append((r.entry_index, r.line_no, r.raw))
    for s, text in logs.items():
        assert sorted(got[s]) == [(i, no, raw) for i, (no, raw) in enumerate(fold(text, starts, ends, explicit))], text


def test_advance_keeps_an_open_entry_over_quiet_batches():
    import pandas as pd

    def batch(*rows):
        return pd.DataFrame(rows, columns=["value", "_st", "_en", "_skip"])

    state = [False, 0, "", 1, 0]
    closed, state = live._advance("s", batch(("", False, False, True), ("S a", True, False, False)), state)
    assert len(closed) == 0 and state == [True, 2, "S a", 3, 0]
    closed, state = live._advance("s", batch(("x", False, False, False), ("", False, False, True)), state)
    assert len(closed) == 0 and state == [True, 2, "S a\nx\n", 5, 0]
    closed, state = live._advance("s", batch(("S b", True, True, False), ("", False, False, True)), state)
    assert list(closed["raw"]) == ["S a\nx\n", "S b"] and list(closed["line_no"]) == [2, 5]
    assert state == [False, 0, "", 7, 2]


def test_detection_from_the_first_batch(spark, tmp_path):
    rng = random.Random(1)
    line = "2026-06-16 10:00:01.000 [HOST:h][SERVER:S][PID:1][THR:2][Core][Trace][UID:0][SID:0][OID:0][a.cpp:1] m"
    spool(tmp_path, {"br": [line, line], "plain": ["just prose", "more"]}, 1, rng)
    got = {r.source: r.schemas for r in live.detect_segments(spark, str(tmp_path)).collect()}
    assert got == {"br": ["Bracketed default"], "plain": ["Generic line"]}


def test_live_timeline_and_stateless_operators(spark, tmp_path):
    line = "2026-06-16 10:{:02d}:01.000 [HOST:h][SERVER:S][PID:1][THR:2][Core][{}][UID:0][SID:0][OID:0][a.cpp:1] m"
    lines = [line.format(m, "Trace" if m % 2 else "Info") for m in range(30)]
    spool(tmp_path / "spool", {"a": lines}, 1, random.Random(1))
    stream = live.spool_lines(spark, str(tmp_path / "spool")).withColumnRenamed("value", "raw")
    parsed = parse(stream, BRACKETED).filter(Lookup(BRACKETED)("level") == "Trace")
    counted = live.live_timeline(parsed, Lookup(BRACKETED)("level"), "10 minutes", "1 minute")
    name = "t" + uuid.uuid4().hex
    query = counted.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.start.minute, r.key, r.entries) for r in spark.table(name).collect())
    assert got == [(0, "Trace", 5), (10, "Trace", 5), (20, "Trace", 5)]


def test_quiet_sources_emit_their_open_entry_once_timed_out(spark, tmp_path):
    spool(tmp_path / "spool", {"a": ["S one", "x"]}, 1, random.Random(1))
    lines = live.spool_lines(spark, str(tmp_path / "spool"))
    folded = live.fold_stream(lines, [START], provisional="timeout", quiet_ms=200)
    name = "t" + uuid.uuid4().hex
    query = folded.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            rows = spark.table(name).collect()
            if rows:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert [(r.raw, r.provisional) for r in rows] == [("S one\nx", True)]
    with pytest.raises(ValueError):
        live.fold_stream(lines, [START], provisional="sometimes")


def test_late_segments_are_reported_and_entries_counted_once(spark, tmp_path):
    folder = tmp_path / "spool" / "a"
    folder.mkdir(parents=True)

    def step(**segments):
        for name, text in segments.items():
            (folder / f"{name}.log").write_text(text)
        lines = live.spool_lines(spark, str(tmp_path / "spool"))
        return live.run_to_folder(live.fold_stream(lines, [START]), str(tmp_path / "out"), str(tmp_path / "check"))

    step(n2="S one\nx\n", n4="y\n")
    step(n3="S late\n", n1="S later\n")
    rows = step(n5="S two\n")
    assert sorted(r.late_segment for r in rows.filter("late_segment IS NOT NULL").collect()) == ["n1.log", "n3.log"]
    got = sorted((r.entry_index, r.raw, r.provisional) for r in live.settled(rows).collect())
    assert got == [(0, "S one\nx\ny", False), (1, "S two", True)]
    assert sorted(r.entry_index for r in rows.filter("first").collect()) == [0, 1]
    # The batch of late segments changed nothing, so nothing was emitted again.
    assert rows.filter("late_segment IS NULL").count() == 3


def test_sources_of_different_formats_fold_in_one_stream(spark, tmp_path):
    rng = random.Random(9)
    spool(tmp_path / "spool", {"s": ["S a", "b", "S c", "S d"], "b": ["{", "x", "}", "{", "}", "{"]}, 2, rng)
    lines = live.spool_lines(spark, str(tmp_path / "spool")).withColumn("schema_set", (F.col("source") == "b").cast("int"))
    rows = live.run_to_folder(live.fold_stream(lines, [START, BOTH], sets=[[0], [1]]), str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted((r.source, r.entry_index, r.raw) for r in live.settled(rows).collect())
    assert got == [("b", 0, "{\nx\n}"), ("b", 1, "{\n}"), ("b", 2, "{"), ("s", 0, "S a\nb"), ("s", 1, "S c"), ("s", 2, "S d")]


def events(spark, folder, n, kinds):
    """A table of events of our own, as the catalog reads it."""
    rows = spark.range(n).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id % 3 AS user_id",
        f"element_at(array({', '.join(repr(k) for k in kinds)}), cast(id % {len(kinds)} + 1 as int)) AS event_type", "1.0D AS value", "concat('{\"k\": ', id % 9, '}') AS props")
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_segments_follow_the_entries_not_the_shuffle_width(spark, tmp_path):
    from brackenlog.catalog.live import LEAST_SEGMENTS, spooled

    data = events(spark, tmp_path, 60, ["error"])
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        folder = spooled(spark, data, written_in_order=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).count() <= LEAST_SEGMENTS


def test_batches_bounded_by_bytes_fold_like_one_batch(spark, tmp_path):
    import json

    from brackenlog.catalog.live import spooled

    folder = spooled(spark, events(spark, tmp_path, 90, ["error", "view"]), written_in_order=True)
    got = []
    for name, most in (("one", None), ("many", 1)):
        lines = live.spool_lines(spark, folder, bytes_per_batch=most)
        rows = live.run_to_folder(live.fold_stream(lines, BRACKETED), str(tmp_path / name), str(tmp_path / f"{name}-check"))
        got.append(sorted((r.source, r.entry_index, r.line_no, r.raw) for r in live.settled(rows).collect()))
        assert rows.filter("late_segment IS NOT NULL").isEmpty()
    assert got[0] == got[1] and len(got[0]) == 90
    assert len([p for p in (tmp_path / "many-check" / "commits").iterdir() if p.name.isdigit()]) > 3
    assert json.loads((tmp_path / "many-check" / "metadata").read_text())


def test_scoped_rules_keep_the_numbers_of_physical_lines(spark, tmp_path):
    from brackenlog.catalog.filters import filter_scoped

    # User 0 logs errors only; every third one has two lines below its head.
    got = [r for r in filter_scoped(spark, events(spark, tmp_path, 18, ["error"])).collect() if r.source == "user-0"]
    assert sorted((r.line_no, r.event_id) for r in got) == [(1 + i, 3 * (i // 3)) for i in range(18)]
