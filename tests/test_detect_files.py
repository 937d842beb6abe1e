import os

import pytest

from brackenlog.logs import open_lines, open_logs
from brackenlog.operators.detect import coverage, detect_schemas, detect_set, detect_single, heal
from brackenlog.operators.extract import Lookup
from brackenlog.plans.builtin import ALL_SCHEMAS, BRACKETED, BUNDLED, GENERIC
from brackenlog.plans.schema import LogSchema
from brackenlog.sources import packs
from brackenlog.sources.files import (
    HiddenFileError, invalid_utf8, read_heads, read_lines, strict_utf8, text_files, write_parsed, write_raw,
)

BR = "2026-06-16 10:00:0{}.000 [HOST:h][SERVER:S][PID:1][THR:2][Core][Trace][UID:0][SID:0][OID:0][a.cpp:1] alpha {}"
MODEM = LogSchema("Modem", "<level>#<gap><message>", field_patterns={"level": "NOTE|FAIL", "gap": r"\s"}, entry_start=r"^(?:NOTE|FAIL)#")
METER = LogSchema("Meter", "meter <addr> at <timestamp>; <message>", time_format="%Y/%m/%d %H:%M:%S", entry_start=r"^meter \w+ at ")
COMPACT = LogSchema("compact", "<timestamp> <level>: <message>", time_format="%H:%M:%S")
LOGS = {
    "bracketed": [BR.format(1, "one"), "   at x", BR.format(2, "two")],
    "plain": ["just prose", "more prose"],
    "mixed": ["meter k7 at 2019/11/02 21:14:05; 18 kWh", "NOTE# line is up", "meter k9 at 2019/11/02 21:15:40; 3 kWh", "(carrier lost)", "FAIL# no dial tone", "NOTE# redial"],
    "app": ["FAIL# q", "NOTE# r", "NOTE# s"],
    "blank": ["", " "],
    "spring": ["2026-07-16 10:00:01.123  INFO 12345 --- [           main] c.e.App : Starting", "java.lang.X: no", "\tat a.b(C.java:8)"],
    "catalina": ["16-Jul-2026 10:00:01.123 INFO [main] a.b.Catalina.start Server startup"],
    "access": ['10.0.0.7 - - [16/Jul/2026:10:00:01 +0000] "GET /app HTTP/1.1" 200 42'],
    "log4j": ["2026-07-16 10:00:01,123 [main] INFO  com.example.Boot - refreshed"],
}


def sample(spark, logs):
    rows = [(s, i, v) for s, lines in logs.items() for i, v in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "source string, line_no long, value string")


def test_detection(spark):
    s = sample(spark, LOGS)
    candidates = [MODEM, METER, *ALL_SCHEMAS]
    got = {r.source: r.schemas for r in detect_schemas(s, candidates).collect()}
    access = ["Tomcat Access Log"]
    assert got == {
        "bracketed": ["Bracketed default"], "plain": ["Generic line"], "mixed": ["Meter", "Modem"], "app": ["Modem"],
        "blank": ["Bracketed default"], "spring": ["Spring Boot"], "catalina": ["Tomcat Catalina"],
        "access": access, "log4j": ["Log4j2 Default"],
    }
    assert {r.source for r in detect_set(s, candidates).collect()} == set(LOGS) - {"plain", "blank"}
    single = {r.source: r.schema_name for r in detect_single(s, ALL_SCHEMAS).collect()}
    assert single["plain"] == "Generic line" and single["access"] == "Tomcat Access Log" and "blank" not in single
    assert {r.source for r in detect_single(s, [BRACKETED, COMPACT]).collect()} == {"bracketed", "spring"}


def test_detection_scores(spark):
    s = sample(spark, {"bracketed": LOGS["bracketed"]})
    got = {r.schema_name: (r.matched, r.total) for r in coverage(s, [BRACKETED, GENERIC]).collect()}
    assert got == {"Bracketed default": (2, 2), "Generic line": (3, 3)}
    ties = [LogSchema(n, "<message>") for n in ("ccc", "aaa", "bbb")]
    assert [r.schema_name for r in detect_single(s, ties).collect()] == ["aaa"]


def test_a_block_schema_matches_no_line_but_its_entries(spark):
    block = LogSchema("block", "{\n 'a': '<a>'\n}", entry_start=r"^\s*\{\s*$", entry_end=r"^\s*\}\s*$")
    s = sample(spark, {"b": ["{", " 'a': '1'", "}", "", "{", " 'a': '2'", "}"]})
    assert detect_set(s, [block]).count() == 0
    assert [r.schemas for r in detect_schemas(s, [block, BRACKETED]).collect()] == [["block"]]
    got = open_lines(s, [block]).orderBy("entry_index").collect()
    assert [(r.line_no, r.fields.a) for r in got] == [(1, "1"), (5, "2")]


def test_heal(spark):
    s = sample(spark, LOGS)
    rows = [("plain", "Bracketed default"), ("app", "Modem"), ("blank", "Modem")]
    assigned = spark.createDataFrame(rows, "source string, schema_name string")
    got = {r.source: r.schema_name for r in heal(assigned, s, [MODEM, *ALL_SCHEMAS]).collect()}
    assert got == {"plain": "Generic line", "app": "Modem", "blank": "Modem"}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b.log").write_text("\n".join(LOGS["bracketed"]) + "\n")
    (tmp_path / "a b.txt").write_bytes("\n".join(LOGS["mixed"]).replace("\n", "\r\n").encode() + b"\r\n")
    (tmp_path / "cr.log").write_bytes(b"one\rstill one\r\r\ntwo\n\n")
    (tmp_path / "bin.dat").write_bytes(b"text\0binary")
    (tmp_path / "late.dat").write_bytes(b"x" * 9000 + b"\0")
    (tmp_path / "bad.log").write_bytes(b"ok\n\xff\xfe\n")
    (tmp_path / "nested").mkdir()
    (tmp_path / "nested" / "c.log").write_text("nested\n")
    return tmp_path


def test_folder_scan(spark, folder):
    names = [os.path.basename(p) for p in text_files(spark, str(folder))]
    assert names == ["a b.txt", "b.log", "bad.log", "cr.log", "late.dat"]
    (folder / "_hidden.log").write_text("x\n")
    with pytest.raises(HiddenFileError):
        text_files(spark, str(folder))
    assert len(text_files(spark, str(folder), skip_hidden=True)) == 5
    with pytest.raises(HiddenFileError):
        read_lines(spark, [str(folder / "_hidden.log")])


def test_lines_keep_lone_carriage_returns(spark, folder):
    rows = read_lines(spark, [str(folder / "cr.log")] * 2).orderBy("pos").collect()
    assert [r.value for r in rows] == ["one\rstill one", "two", ""]
    heads = read_heads(spark, [str(folder / "cr.log"), str(folder / "bin.dat")], limit=2).collect()
    assert sorted((os.path.basename(r.source), r.line_no, r.value) for r in heads) == [
        ("bin.dat", 1, "text\0binary"), ("cr.log", 1, "one\rstill one"), ("cr.log", 2, "two")]


def test_utf8(spark, folder):
    lines = read_lines(spark, [str(folder / "bad.log"), str(folder / "cr.log")])
    assert [r.bad_lines for r in invalid_utf8(lines).collect()] == [1]
    assert strict_utf8(lines).count() == 3


def test_a_folder_opens_with_every_file_under_its_own_schemas(spark, folder):
    files = [str(folder / n) for n in ("a b.txt", "b.log", "cr.log")]
    df = open_logs(spark, files, [MODEM, METER, *ALL_SCHEMAS])
    got = {}
    for r in df.orderBy("entry_index").collect():
        got.setdefault(r.source.rsplit("/", 1)[-1], []).append((r.entry_index, r.line_no, r.schema_name, r.fields.level, r.fields.message))
    assert [g[1:3] for g in got["b.log"]] == [(1, "Bracketed default"), (3, "Bracketed default")]
    assert got["b.log"][0][4] == "alpha one\n   at x"
    assert [g[2] for g in got["a%20b.txt"]] == ["Meter", "Modem", "Meter", "Modem", "Modem"]
    assert [g[4] for g in got["cr.log"]] == ["one\rstill one", "two", ""]


def test_no_files_are_no_entries(spark):
    df = open_logs(spark, [])
    assert df.count() == 0 and {"source", "entry_index", "line_no", "raw", "schema_name", "ts", "fields"} <= set(df.columns)


def test_empty_files_hold_no_entries(spark, folder):
    (folder / "empty.log").write_text("")
    empty, full = str(folder / "empty.log"), str(folder / "b.log")
    assert read_heads(spark, [empty]).count() == 0
    assert [os.path.basename(r.source) for r in read_heads(spark, [empty, full], limit=1).collect()] == ["b.log"]
    entries = lambda paths: sorted((r.entry_index, r.line_no, r.raw) for r in open_logs(spark, paths).collect())
    assert entries([empty, full]) == entries([full]) and len(entries([full])) == 2
    df = open_logs(spark, [empty])
    assert df.count() == 0 and set(df.columns) == set(open_logs(spark, []).columns)


def test_fields_of_formats_that_do_not_occur_read_as_empty(spark, folder):
    field = Lookup(ALL_SCHEMAS)
    df = open_logs(spark, [str(folder / "b.log")])
    names = list(dict.fromkeys(n for s in ALL_SCHEMAS for n in s.fields))
    first = df.orderBy("entry_index").select(field("level").alias("lv"), *(field(n).alias(f"f{i}") for i, n in enumerate(names))).first()
    assert first.lv == "Trace" and all(v is not None for v in first) and "" in tuple(first)
    lines = read_lines(spark, [str(folder / "b.log")])
    assert open_lines(lines).where(field("level") == "Trace").count() == 2


def test_a_file_in_many_splits(spark, tmp_path):
    lines = [BR.format(i % 10, i) if i % 3 == 0 else f"  at {i}" for i in range(400)]
    (tmp_path / "big.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = open_logs(spark, [str(tmp_path / "big.log")])
        assert read_lines(spark, [str(tmp_path / "big.log")]).select("split").distinct().count() > 5
        got = [(r.entry_index, r.line_no, r.raw) for r in df.orderBy("entry_index").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, 3 * i + 1, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(134)]


def test_a_second_scan_may_cut_files_otherwise(spark, tmp_path):
    lines = [BR.format(i % 10, i) if i % 3 == 0 else f"  at {i}" for i in range(400)]
    (tmp_path / "big.log").write_text("\n".join(lines) + "\n")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "12")
        df = open_logs(spark, [str(tmp_path / "big.log")])
        # What Spark does by itself when an executor with a third of the cores is lost.
        spark.conf.set("spark.sql.files.minPartitionNum", "8")
        got = [(r.entry_index, r.line_no, r.raw) for r in df.orderBy("entry_index").collect()]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, 3 * i + 1, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(134)]


def test_sinks(spark, folder, tmp_path):
    df = open_logs(spark, [str(folder / "b.log")])
    df = df.select("raw", "ts", Lookup(BRACKETED)("level").alias("level"))
    write_parsed(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("level = 'Trace' and date = '2026-06-16'").count() == 2
    write_raw(df, str(tmp_path / "raw"))
    assert spark.read.text(str(tmp_path / "raw")).count() == 3


def test_packs(spark, tmp_path):
    a, b = tmp_path / "project", tmp_path / "user"
    a.mkdir(), b.mkdir()
    (a / "1.json").write_text('{"name":"S","description":"","schema":{"name":"S","format":"<a> mine <b>","field_patterns":{"a":"x+"},"samples":[{"line":"x mine y"}]}}')
    (b / "1.json").write_text('{"name":"S","format":"<a> <b>"}')
    (b / "2.json").write_text('{"name":"T","format":"<c>","entry_start":"^x"}')
    library = packs.tiered([("project", packs.schema_pack(spark, str(a))), ("user", packs.schema_pack(spark, str(b)))])
    kept = packs.first_by_name(library)
    assert {(r.name, r.origin) for r in kept.collect()} == {("S", "project"), ("T", "user")}
    schemas = {s.name: s for s in packs.load_schemas(kept)}
    assert schemas["S"].template == "<a> mine <b>" and schemas["S"].field_patterns == {"a": "x+"}
    assert schemas["T"].entry_start == "^x" and schemas["S"].samples[0].level is None

    rules = tmp_path / "rules"
    rules.mkdir()
    (rules / "1.json").write_text('{"name":"n","description":"d","filter":{"field":"level","op":"equals","value":"Trace","action":"include","enabled":false}}')
    (rules / "2.json").write_text('{"field":"message","value":"x","log_schema":"S"}')
    one, two = packs.load_rules(packs.rule_pack(spark, str(rules)))
    assert (one.op, one.action, one.enabled) == ("equals", "include", False)
    assert (two.op, two.action, two.log_schema) == ("contains", "exclude", "S")

    searches = tmp_path / "searches"
    searches.mkdir()
    (searches / "1.json").write_text('{"name":"n","query":"level=Error"}')
    (searches / "2.json").write_text('"just text"')
    got = packs.search_pack(spark, str(searches)).orderBy("path").collect()
    assert [(r.name, r.query) for r in got] == [("n", "level=Error"), ("search-001-just text", "just text")]


def test_bundled_names():
    assert len(BUNDLED) == 5 and len({s.name for s in ALL_SCHEMAS}) == 7
