import datetime as dt

import pytest
from pyspark.sql import functions as F

from brackenlog.functions.timefmt import parse_datetime, parse_datetime_col, parse_time, sniff_time
from brackenlog.operators.extract import Lookup, check_samples, elapsed_text, parse, sample_report
from brackenlog.plans.builtin import ALL_SCHEMAS, BRACKETED, BUNDLED, GENERIC
from brackenlog.plans.schema import LogSchema, SchemaError

HEAD = "2024-05-04 01:02:03.5 [HOST:h1][SERVER:S][PID:5][THR:6][Core][{}]{}[UID:u][SID:s][OID:o][F.cpp:9] {}"
T = dt.datetime


def rows(spark, texts, schemas, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    return [r for r in parse(df, schemas, **kw).orderBy("i").collect()]


def test_bracketed_fields_with_and_without_the_optional_code(spark):
    a, b, c = rows(
        spark,
        [HEAD.format("Error", "[0x80]", "boom"), HEAD.format("Error", "", "plain\n  at x\n\n  at y"), "no match\nmore"],
        BRACKETED,
    )
    assert (a.fields.log_level, a.fields.error_code, a.fields.user_id, a.fields.message) == ("Error", "0x80", "u", "boom")
    assert (b.fields.log_level, b.fields.error_code, b.fields.line_number) == ("Error", "", "9")
    assert b.fields.message == "plain\n  at x\n\n  at y"
    assert a.ts == T(2024, 5, 4, 1, 2, 3, 500000)
    # An entry the template does not match keeps its text in the last field.
    assert c.fields.message == "no match\nmore" and c.fields.log_level == "" and c.ts is None


def test_marker_in_the_text_changes_nothing(spark):
    noisy = HEAD.format("Err\u0001or", "", "a\u0001b\u0002\u0001\n\u0001c").replace("[Core]", "[\u0002\u0002Co\u0001re]")
    (r,) = rows(spark, [noisy], BRACKETED)
    assert r.fields.log_level == "Err\u0001or" and r.fields.log_module == "\u0002\u0002Co\u0001re"
    assert r.fields.message == "a\u0001b\u0002\u0001\n\u0001c" and r.fields.line_number == "9"


def test_optional_field_takes_the_literal_before_it(spark):
    schema = LogSchema("opt", "[<a>][<b?>][C:<c>]")
    x, y = rows(spark, ["[1][2][C:3]", "[1][C:3]"], schema)
    assert tuple(x.fields) == ("1", "2", "3") and tuple(y.fields) == ("1", "", "3")


def test_text_behind_a_closed_template_is_dropped_and_continuation_joins_the_last_field(spark):
    (r,) = rows(spark, ['{"m":"x","l":"INFO"} tail\nnext'], LogSchema("j", '{"m":"<m>","l":"<l>"}'))
    assert r.fields.m == "x" and r.fields.l == "INFO\nnext"


def test_block_schema_reads_values_over_several_lines(spark):
    schema = LogSchema("ticket", "<<< <id>\nopened <timestamp>\n<story>\n>>> <owner>", time_format="%d.%m.%Y %H:%M", entry_start=r"^<<< ", entry_end=r"^>>> ")
    raw = "<<< 81\nopened 09.08.2017 22:05\npump stalls\nafter rain\n>>> maren"
    r, bad = rows(spark, [raw, "<<< 82\nno more"], schema)
    assert tuple(r.fields) == ("81", "09.08.2017 22:05", "pump stalls\nafter rain", "maren")
    assert r.ts == T(2017, 8, 9, 22, 5)
    assert tuple(bad.fields) == ("", "", "", "<<< 82\nno more")


def test_only_wanted_fields(spark):
    (r,) = rows(spark, [HEAD.format("Info", "", "m")], BRACKETED, wanted=["log_level", "message"], time=False)
    assert r.fields.asDict() == {"log_level": "Info", "message": "m"}


def test_sub_pattern_groups_do_not_shift_fields(spark):
    schema = LogSchema("g", "<a> <b> <c>", field_patterns={"a": "(x|(y))+", "b": r"(?P<n>\d+)"})
    (r,) = rows(spark, ["xyx 12 rest of"], schema)
    assert tuple(r.fields) == ("xyx", "12", "rest of")


MIXED = [
    LogSchema("modem", "<level>#<gap><message>", field_patterns={"level": "NOTE|FAIL", "gap": r"\s"}, entry_start=r"^(?:NOTE|FAIL)#"),
    LogSchema("meter", "meter <addr> at <timestamp>; <message>", time_format="%Y/%m/%d %H:%M:%S %z", entry_start=r"^meter \w+ at "),
]


def test_each_entry_takes_the_first_schema_that_parses_it(spark):
    stray, note, meter = rows(spark, ["(carrier lost)", "NOTE# dialled", "meter k7 at 2019/11/02 21:14:05 -0330; 18 kWh"], MIXED)
    assert (stray.schema_name, stray.fields.message, stray.fields.level) == ("modem", "(carrier lost)", "")
    assert (note.schema_name, note.fields.level, note.fields.message) == ("modem", "NOTE", "dialled")
    assert (meter.schema_name, meter.fields.addr, meter.ts) == ("meter", "k7", T(2019, 11, 2, 21, 14, 5))
    assert rows(spark, ["meter k7 at noon; 2 kWh"], MIXED, primary_only=True)[0].schema_name == "modem"


def test_fields_that_were_not_read_are_missing(spark):
    df = parse(spark.createDataFrame([(HEAD.format("Warn", "", "m"),)], "raw string"), BRACKETED, wanted=["message"], time=False)
    g = Lookup(BRACKETED, frame=df)
    assert tuple(df.select(g("level"), g("message")).first()) == ("", "m")
    assert tuple(df.select(Lookup(BRACKETED, frame=df.drop("fields"))("level")).first()) == ("",)


def test_aliases_and_virtual_names(spark):
    df = spark.createDataFrame([("NOTE# up",), ("meter k7 at 2019/11/02 21:14:05 +0000; 18 kWh",)], "raw string")
    f = Lookup(MIXED)
    got = parse(df, MIXED).select(f("level"), f("addr"), f("message"), f("raw"), f("source"), f("nope"), f.message()).collect()
    assert [tuple(r)[:3] + tuple(r)[4:] for r in got] == [
        ("NOTE", "", "up", "", "", "up"), ("", "k7", "18 kWh", "", "", "18 kWh")]
    bracketed = parse(spark.createDataFrame([(HEAD.format("Warn", "", ""),)], "raw string"), BRACKETED)
    g = Lookup(BRACKETED)
    row = bracketed.select(g("level"), g("module"), g("pid"), g("file"), g("line"), g("thread"), g.message()).first()
    assert tuple(row)[:6] == ("Warn", "Core", "5", "F.cpp", "9", "6") and row[6].endswith("F.cpp:9] ")


TIMES = [
    ("2024-05-04 01:02:03.5", "%Y-%m-%d %H:%M:%S.%f", T(2024, 5, 4, 1, 2, 3, 500000)),
    ("2024-05-04 01:02:03.123456", "%Y-%m-%d %H:%M:%S.%f", T(2024, 5, 4, 1, 2, 3, 123456)),
    ("2024-05-04 01:02:03.2880000", "%Y-%m-%d %H:%M:%S.%f", T(2024, 5, 4, 1, 2, 3, 2880)),
    (" 2024-5-4 1:2:3,088 ", "%Y-%m-%d %H:%M:%S,%f", T(2024, 5, 4, 1, 2, 3, 88000)),
    ("2024-05-04 01:02:03,5", "%Y-%m-%d %H:%M:%S.%f", None),
    ("2024-05-04 01:02:03.123", "%Y-%m-%d %H:%M:%S%.3f", T(2024, 5, 4, 1, 2, 3, 123000)),
    ("2024-05-04 01:02:03,123", "%Y-%m-%d %H:%M:%S,%3f", T(2024, 5, 4, 1, 2, 3, 123000)),
    ("2024-05-04T01:02:03.123Z", "%Y-%m-%dT%H:%M:%S%.3fZ", T(2024, 5, 4, 1, 2, 3, 123000)),
    ("16-JUL-2026 10:00:01.123", "%d-%b-%Y %H:%M:%S%.3f", T(2026, 7, 16, 10, 0, 1, 123000)),
    ("16-Foo-2026 10:00:01.123", "%d-%b-%Y %H:%M:%S%.3f", None),
    ("16/Dec/2026:10:00:01 +0800", "%d/%b/%Y:%H:%M:%S %z", T(2026, 12, 16, 10, 0, 1)),
    ("2024-02-30 01:02:03.5", "%Y-%m-%d %H:%M:%S.%f", None),
    ("2024-05-04 01:02:03.5 x", "%Y-%m-%d %H:%M:%S.%f", None),
    ("10:00:01", "%H:%M:%S", None),
    ("2024-05-04 01", "%Y-%m-%d %H", None),
    ("2024-05-04 01:02", "%Y-%m-%d %H:%M", T(2024, 5, 4, 1, 2)),
]


def test_time_formats(spark):
    for text, fmt, want in TIMES:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(parse_time(F.col("t"), fmt)).first()[0] == want, (text, fmt)


def test_sniffed_times(spark):
    cases = {
        "2026-06-16 10:09:43.288 INFO x": T(2026, 6, 16, 10, 9, 43, 288000),
        "2026-06-16T10:09:43,288Z INFO x": T(2026, 6, 16, 10, 9, 43, 288000),
        "[2026/06/16 10:09:43.288] x\n2020-01-01 00:00:00": T(2026, 6, 16, 10, 9, 43, 288000),
        "2026-06-16 10:09:43.2880000 x": T(2026, 6, 16, 10, 9, 43, 288000),
        "2026-06-16 10:09:43": T(2026, 6, 16, 10, 9, 43),
        "  at Foo": None, "2026-13-45 10:09:43 x": None, "10:09:43 WARN": None, "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.s for r in df.select("t", sniff_time(F.col("t")).alias("s")).collect()} == cases


def test_a_time_only_format_falls_back_to_the_line(spark):
    schema = LogSchema("simple", "<timestamp> <level>: <message>", time_format="%H:%M:%S")
    assert rows(spark, ["10:00:01 WARN: full"], schema)[0].ts is None
    (r,) = rows(spark, ["2026-06-16 10:00:02,500 INFO beta"], GENERIC)
    assert r.ts == T(2026, 6, 16, 10, 0, 2, 500000) and r.fields.message.endswith("beta")


BOUNDS = {
    "2026-06-16": T(2026, 6, 16), "2026-06-16 10:09": T(2026, 6, 16, 10, 9), "'2026-06-16T10:09:43.288'": T(2026, 6, 16, 10, 9, 43, 288000),
    "2026/06/16_10:09:43": T(2026, 6, 16, 10, 9, 43), "2026/6/16": T(2026, 6, 16), "10:09": T(1900, 1, 1, 10, 9),
    "10:09:43": T(1900, 1, 1, 10, 9, 43), "10:09:43.288000000": T(1900, 1, 1, 10, 9, 43, 288000), "1:2:3.5": T(1900, 1, 1, 1, 2, 3), "2026-06-16 10": None, "nonsense": None, "2026-02-31": None, "": None,
}


def test_date_text_in_bounds(spark):
    assert {text: parse_datetime(text) for text in BOUNDS} == BOUNDS
    df = spark.createDataFrame([(b,) for b in BOUNDS], "t string")
    assert {r.t: r.b for r in df.select("t", parse_datetime_col(F.col("t")).alias("b")).collect()} == BOUNDS


def test_samples(spark):
    assert sample_report(spark, ALL_SCHEMAS).filter("problem is not null").count() == 0
    old = LogSchema("old", BRACKETED.template.replace("[<error_code?>]", ""))
    lines = spark.createDataFrame([(HEAD.format("Error", "[0x80]", "m"), "Error"), ("nope", None)], "raw string, expected string")
    got = check_samples(lines, old).orderBy("raw").collect()
    assert (got[0].parsed, got[0].problem) == ("Error][0x80", "wrong level")
    assert got[1].problem == "does not match the format"
    bare = check_samples(lines, GENERIC).filter("expected is not null").first()
    assert bare.problem == "the format has no level field"
    # Every bundled schema also reads the time of its own samples.
    for schema in BUNDLED:
        assert all(r.ts for r in rows(spark, [s.line for s in schema.samples], schema)), schema.name


def test_a_bad_schema_is_refused():
    with pytest.raises(SchemaError):
        LogSchema("twice", "<a> <a>")
    with pytest.raises(ValueError):
        LogSchema("bad", "<a> <b>", entry_start="(")


def test_pinned_fields(spark):
    trace, error = HEAD.format("Trace", "", "m\n at x"), HEAD.format("Error", "[0x8]", "m")
    df = spark.createDataFrame([(trace,), (error,)], "raw string")

    def hits(**chosen):
        return [r[0] for r in df.select(BRACKETED.pinned(F.col("raw"), chosen)).collect()]

    assert hits(host="h1", log_level="Trace") == [True, False]
    assert hits(error_code="0x8") == [False, True]
    assert hits(error_code="", log_level="Trace") == [True, False]
    assert hits(host="h2") == [False, False]
    assert LogSchema("bare", "no fields").pinned_pattern({}) is None


def test_elapsed_text(spark):
    cases = {-28812000: "-28.812s", 0: "+0ms", 116531000: "+1m56.531s", 123644000: "+2m03.644s", None: "-", 3723004000: "+1h02m03.004s"}
    df = spark.createDataFrame([(c,) for c in cases], "g long")
    assert {r.g: r.t for r in df.select("g", elapsed_text(F.col("g")).alias("t")).collect()} == cases


def test_fast_and_lazy_header_forms_agree(spark):
    import random
    import re

    from pyspark.sql import Row

    rng = random.Random(7)
    schemas = [
        BRACKETED,
        LogSchema("o", "[<a>][<b?>][C:<c>] <m>"),
        LogSchema("p", "<a>: <b> - <c?>; <m>"),
        LogSchema("q", "<a?>x<b> [<c>] <m>"),
        LogSchema("r", "<a><b> <m>"),
    ]
    for schema in schemas:
        pieces = [s.literal for s in schema.slots] + ["a", "]", "[", " ", "-", ":", "][", "C:", "x", "\\"]
        texts = []
        for _ in range(400):
            full = "".join(
                ("" if s.optional and rng.random() < 0.5 else s.literal + "".join(rng.choices(pieces[-10:], k=rng.randint(0, 2))))
                for s in schema.slots
            )
            at = rng.randint(0, len(full))
            texts.append(full if rng.random() < 0.6 else full[:at] + rng.choice(pieces) + full[at:])
        lazy = schema._assemble(header_only=True)
        lazy = re.sub(r"^\(\?ds\)\\A", "(?s)\\\\A", lazy).replace("(?<", "(?P<")
        df = spark.createDataFrame([Row(i=i, raw=t) for i, t in enumerate(texts)])
        for r in parse(df, schema, time=False).collect():
            found = re.match(lazy, r.raw)
            if not found:
                assert r.fields[schema.message_field] == r.raw
                continue
            want = [found.group(f"f{i}") or "" for i in range(len(schema.slots) - 1)] + [r.raw[found.end():]]
            assert list(r.fields) == want, (schema.name, r.raw)
