import random

import pytest
from models import fold
from pyspark.sql import functions as F

from brackenlog.operators.extract import Lookup
from brackenlog.plans.builtin import BRACKETED
from brackenlog.plans.schema import LogSchema
from brackenlog.sources.tail import TailError, _Stream, tail_lines
from brackenlog.streaming import follow as fl

START = LogSchema("start", "<a> <b>", entry_start=r"^S")
BOTH = LogSchema("both", "<a> <b>", entry_start=r"^\{", entry_end=r"^\}")
WORDS = ["", " ", "S one", "x", "S two é", "y: z", "a b"]


def write(path, text, mode="ab"):
    with open(path, mode) as f:
        f.write(text.encode() if isinstance(text, str) else text)


def entries(spark, folder):
    got = {}
    for r in fl.followed_entries(spark, str(folder)).collect():
        got.setdefault(r.source.rsplit("/")[-1], []).append((r.entry_index, r.line_no, r.raw, r.provisional))
    return {k: sorted(v) for k, v in got.items()}


def test_ranges_give_every_line_once_wherever_they_are_cut(spark, tmp_path):
    rng = random.Random(3)
    text = [rng.choice(["", "a", "bb é", "c" * rng.randint(1, 40)]) for _ in range(200)]
    write(tmp_path / "one.log", "\r\n".join(text) + "\r\nnot yet complete")
    write(tmp_path / "empty.log", "")
    raw = (tmp_path / "one.log").read_bytes()
    for size in (1, 7, 64, 1 << 20):
        rows = tail_lines(spark, str(tmp_path), stream=False, splitBytes=size).orderBy("pos").collect()
        assert [r.value for r in rows] == text
        assert all(r.pos == 0 or raw[r.pos - 1 : r.pos] == b"\n" for r in rows)
        assert all(r.split <= r.pos < r.split + size for r in rows)


def test_offsets_end_with_complete_lines(tmp_path):
    stream = _Stream({"path": str(tmp_path)})
    path = str(tmp_path / "a.log")
    assert stream.latestOffset() == {}
    write(path, "one\ntw")
    assert stream.latestOffset() == {path: 4}
    write(path, "o\nthree")
    assert stream.latestOffset() == {path: 8}
    assert [(p.start, p.stop) for p in stream.partitions({path: 4}, {path: 8})] == [(4, 8)]
    write(path, "x", "wb")
    with pytest.raises(TailError, match="shrank"):
        stream.latestOffset()


def test_broken_utf8_names_its_place(spark, tmp_path):
    write(tmp_path / "a.log", b"fine\nbro\xffken\n")
    with pytest.raises(Exception, match="byte 5 is not UTF-8"):
        tail_lines(spark, str(tmp_path), stream=False).collect()
    rows = tail_lines(spark, str(tmp_path), stream=False, utf8="replace").orderBy("pos").collect()
    assert [r.value for r in rows] == ["fine", "bro�ken"]


@pytest.mark.parametrize("schemas,starts,ends", [([START], [r"^S"], []), ([BOTH], [r"^\{"], [r"^\}"])])
def test_growing_files_and_a_restarted_query_give_the_batch_fold(spark, tmp_path, schemas, starts, ends):
    rng = random.Random(len(ends))
    spool, out, check = tmp_path / "spool", tmp_path / "out", str(tmp_path / "check")
    spool.mkdir()
    words = WORDS if not ends else ["{", "}", "", "x", " ", "{ y"]
    heads = {"a.log": schemas[0].template and ("S zero" if not ends else "{"), "b.log": "S b" if not ends else "{"}
    logs = {name: [heads[name], *rng.choices(words, k=30)] for name in heads}
    # Bytes arrive in pieces that end anywhere, a file at a time or both, and each step is a new query.
    data = {name: ("\n".join(lines) + "\n").encode() for name, lines in logs.items()}
    at = dict.fromkeys(data, 0)
    for step in range(5):
        for name, text in data.items():
            end = len(text) if step == 4 else rng.randint(at[name], len(text))
            write(spool / name, text[at[name] : end])
            at[name] = end
        lines = tail_lines(spark, str(spool), splitBytes=23)
        fl.follow(lines, str(out), check, schemas).awaitTermination()
    got = entries(spark, out)
    for name, text in logs.items():
        want = [(i, no, raw) for i, (no, raw) in enumerate(fold(text, starts, ends, True))]
        assert [x[:3] for x in got[name]] == want, (name, text)
        assert [x[3] for x in got[name][:-1]] == [False] * (len(want) - 1)


def batch(spark, rows):
    at, out = {}, []
    for source, split, value in rows:
        at[source] = at.get(source, 0) + 1
        out.append((source, split, at[source], value))
    return spark.createDataFrame(out, "source string, split long, pos long, value string").coalesce(1)


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    first = batch(spark, [("a", 0, "S one"), ("a", 0, "x"), ("b", 0, "S b")])
    second = batch(spark, [("a", 9, "y"), ("a", 9, "S two")])
    fl.fold_batch(first, folder, 0, [START])
    fl.fold_batch(second, folder, 1, [START])
    want = entries(spark, folder)
    assert want == {"a": [(0, 1, "S one\nx\ny", False), (1, 4, "S two", True)], "b": [(0, 1, "S b", True)]}
    fl.fold_batch(second, folder, 1, [START])
    assert entries(spark, folder) == want
    fl.fold_batch(batch(spark, []), folder, 2, [START])
    assert entries(spark, folder) == want
    # Cut off after its entries were written: the state still says what holds.
    spark.createDataFrame([("a", 7, 7, "junk", False)], f"{fl.ENTRIES}, open boolean").write.partitionBy("open").parquet(f"{folder}/entries/batch=3")
    assert entries(spark, folder) == want
    fl.fold_batch(batch(spark, [("b", 5, "S c")]), folder, 3, [START])
    assert entries(spark, folder)["b"] == [(0, 1, "S b", False), (1, 2, "S c", True)]


def test_lines_of_one_source_are_split_over_tasks(spark, tmp_path):
    rows = [("hot", n // 250, f"S {n}" if n % 3 == 0 else "x") for n in range(1000)]
    lines = batch(spark, rows).repartitionByRange(4, "split").sortWithinPartitions("split", "pos")
    fl.fold_batch(lines, str(tmp_path), 0, [START])
    assert len(entries(spark, tmp_path)["hot"]) == 334


def test_a_source_of_another_format_joins_later(spark, tmp_path):
    line = "2031-02-03 04:05:{:02d}.000 [HOST:h][SERVER:S][PID:1][THR:2][Core][{}][UID:0][SID:0][OID:0][a.cpp:1] m{}"
    other = "2031-02-03 04:05:{:02d},000 [main] {} org.example.Runner - r{}"
    folder = str(tmp_path)
    fl.fold_batch(batch(spark, [("a", 0, line.format(n, "Trace", n)) for n in range(4)]), folder, 0)
    fl.fold_batch(batch(spark, [("a", 9, line.format(9, "Error", 9)), *(("b", 0, other.format(n, "ERROR", n)) for n in range(5))]), folder, 1)
    found = {r.source: r.schemas for r in fl.followed_state(spark, folder).collect()}
    assert found["a"] == [BRACKETED.name] and found["b"] != found["a"]
    logs = fl.open_followed(spark, folder)
    from brackenlog.plans.builtin import ALL_SCHEMAS

    field = Lookup([BRACKETED, *ALL_SCHEMAS])
    shown = logs.where(F.lower(field("level")) == "error").select("source", field("message").alias("message"), "ts").collect()
    assert sorted((r.source, r.message) for r in shown) == [("a", "m9"), *(("b", f"r{n}") for n in range(5))]
    assert all(r.ts is not None for r in shown)
