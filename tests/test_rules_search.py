import pytest
from pyspark.sql import functions as F

from brackenlog.operators.extract import Lookup, parse
from brackenlog.plans import rules as R
from brackenlog.plans.builtin import BRACKETED, GENERIC, SAVED_SEARCHES
from brackenlog.plans.rules import Rule, add, apply_rules, one_time_range
from brackenlog.plans.schema import LogSchema
from brackenlog.plans.search import compile_search, last_range, mark, search, tag, words

LINE = "2026-06-16 10:09:{s:02d}.000 [HOST:h{h}][SERVER:S][PID:1][THR:2][{m}][{l}][UID:0][SID:0][OID:0][f.cpp:{n}] {t}"
DATA = [
    (1, 1, "Kernel", "Trace", "Cache miss for key 7"),
    (10, 1, "Net", "Info", "Accepted from 10.0.0.5"),
    (20, 2, "SQL", "Warn", "Query completed in 1200ms"),
    (30, 2, "Kernel", "Error", "Out of memory"),
    (40, 1, "SQL", "Trace", "SELECT qty"),
]
SIMPLE = LogSchema("simple", "<timestamp> <level>: <message>", time_format="%H:%M:%S")
f = Lookup(BRACKETED)


@pytest.fixture(scope="module")
def log(spark):
    lines = [(i, LINE.format(s=s, h=h, m=m, l=l, n=i, t=t)) for i, (s, h, m, l, t) in enumerate(DATA)]
    return parse(spark.createDataFrame(lines, "i int, raw string"), BRACKETED).cache()


def kept(log, *rules):
    return [r.i for r in apply_rules(log, list(rules), f).orderBy("i").collect()]


def test_rule_composition(log):
    assert kept(log) == [0, 1, 2, 3, 4]
    assert kept(log, Rule("level", "equals", "Trace", "exclude")) == [1, 2, 3]
    assert kept(log, Rule("level", "equals", "Error", "include"), Rule("level", "equals", "Warn", "include")) == [2, 3]
    assert kept(log, Rule("module", "contains", "sql", "include"), Rule("level", "equals", "Trace", "exclude")) == [2]
    assert kept(log, Rule("message", "regex", r"\d+ms|memory", "exclude")) == [0, 1, 4]
    assert kept(log, Rule("message", "regex", r"MEMORY", "exclude")) == [0, 1, 2, 3, 4]
    assert kept(log, Rule("message", "regex", "(unclosed", "exclude")) == [0, 1, 2, 3, 4]
    assert kept(log, Rule("message", "regex", "(unclosed", "include")) == []
    assert kept(log, Rule("level", "nosuch", "x", "include")) == []
    assert kept(log, Rule("level", "equals", "Trace", "exclude", enabled=False)) == [0, 1, 2, 3, 4]


def test_ranges(log):
    def t(value):
        return kept(log, Rule("timestamp", "range", value, "include"))

    assert t("2026-06-16 10:09:10..2026-06-16 10:09:30") == [1, 2, 3]
    assert t("2026-06-16 10:09:30..") == [3, 4]
    assert t("..2026-06-16 10:09:10") == [0, 1]
    assert t("nonsense..2026-06-16 10:09:10") == [0, 1]  # a bad bound is open
    assert kept(log, Rule("line", "range", "1..3", "include")) == [1, 2, 3]
    assert kept(log, Rule("error_code", "range", "..z", "include")) == [0, 1, 2, 3, 4]
    assert kept(log, Rule("error_code", "range", "0..", "include")) == []


def test_scoped_rules(spark):
    schemas = [BRACKETED, SIMPLE]
    df = spark.createDataFrame([(LINE.format(s=1, h=1, m="K", l="Trace", n=1, t="a"),), ("10:00:01 Trace: b",)], "raw string")
    df, g = parse(df, schemas), Lookup(schemas)

    def kept(*rules):
        return sorted(r[0] for r in apply_rules(df, list(rules), g).select(g("message")).collect())

    assert kept(Rule("level", "equals", "Trace", "exclude", "Bracketed default")) == ["b"]
    assert kept(Rule("level", "equals", "Error", "include", "Bracketed default")) == ["b"]
    assert kept(Rule("level", "equals", "Trace", "exclude", "simple")) == ["a"]
    assert kept(Rule("level", "equals", "Error", "include", "simple"), Rule("level", "equals", "Trace", "include", " ")) == ["a", "b"]


def test_time_slot(spark):
    level, sql = Rule("level", "equals", "x"), Rule("module", "contains", "SQL")
    ab, cd = Rule("timestamp", "range", "a..b"), Rule("ts", "range", "c..d")
    assert add(add(add([level], ab), sql), cd) == [level, cd, sql]
    assert one_time_range([ab, level, cd]) == [level, cd]
    assert one_time_range([level]) == [level]
    assert not Rule("line_number", "range", "1..9").is_time_range
    table = R.to_table(spark, [ab, level, cd])
    assert R.from_table(R.newest_time_range(table)) == [level, cd]


def test_rules_as_tables(spark):
    one, two = Rule("a", "equals", "1", origin="project"), Rule("a", "equals", "1", origin="hub")
    table = R.to_table(spark, [one, two, Rule("a", "equals", "1", enabled=False)])
    got = R.from_table(R.distinct_rules(table))
    assert got == [one, Rule("a", "equals", "1", enabled=False)]


def test_by_example(log):
    row = log.filter("i = 3").select(f("module").alias("module")).first()
    assert kept(log, R.like_row(row, "module")) == [1, 2, 4]
    assert kept(log, R.like_row(row, "keyword", "memory", "include")) == [3]
    examples = log.filter("i = 0").select(f("module").alias("m"))
    assert sorted(r.i for r in R.hide_like(log, examples, f("module")).collect()) == [1, 2, 4]
    assert sorted(r.i for r in R.hide_like(log, examples, f("module"), keep=True).collect()) == [0, 3]


def test_words():
    assert words('a "b c" \'d e\' f\\ g') == ["a", "b c", "d e", "f g"]
    assert words(r'"/in \d+ms/" /in\d/') == [r"/in \d+ms/", "/ind/"]
    assert words('a=b"c d"') == ["a=bc d"]
    assert words("it's late") == ["it's", "late"]
    assert words("a # b c\nd") == ["a", "d"]
    assert words('x#y "" ') == ["x#y", ""]
    assert words("") == []


SEARCHES = {
    "miss": [0], "MISS cache": [0], '"miss for"': [0], "level=Error": [3], "level=error": [], "module~sql level=Warn": [2],
    r'"/COMPLETED in \d+ms/"': [2], "file=/^F\\\\.cpp$/": [0, 1, 2, 3, 4], "line=/^[34]$/": [3, 4],
    "after:2026-06-16T10:09:20 before:2026-06-16T10:09:30": [2, 3],
    "date:[2026-06-16T10:09:05..2026-06-16T10:09:20]": [1, 2], "date:[..2026-06-16T10:09:10]": [0, 1],
    "": [0, 1, 2, 3, 4], "/(unclosed/": [0, 1, 2, 3, 4], "/(unclosed/ Error": [3], "after:nonsense": [0, 1, 2, 3, 4], "date:[x..y]": [0, 1, 2, 3, 4],
}


def test_searches(log):
    for text, want in SEARCHES.items():
        found, errors = search(log, text, f)
        assert sorted(r.i for r in found.collect()) == want, text
        assert bool(errors) == ("unclosed" in text or "nonsense" in text or "x..y" in text), text
    assert not any(r.is_match for r in mark(log, "", f).collect())
    refined = search(search(log, "level=Trace", f)[0], "select", f)[0]
    assert [r.i for r in refined.collect()] == [4]


def test_saved_searches_compile_and_tag(spark):
    texts = ["login token denied", "Postgres pool timed out", "pod restarted", "Caused by: x", "X-Request-ID: 1", "none"]
    df = parse(spark.createDataFrame([(t,) for t in texts], "raw string"), GENERIC)
    for text in SAVED_SEARCHES.values():
        assert compile_search(text, Lookup(GENERIC)).errors == ()
    got = {r.raw: r.tags for r in tag(df, SAVED_SEARCHES, Lookup(GENERIC)).collect()}
    assert [got[t] for t in texts] == [[name] for name in SAVED_SEARCHES] + [[]]


def test_last_range_counts_back_from_the_newest_entry(log):
    assert sorted(r.i for r in last_range(log, "20 seconds").collect()) == [2, 3, 4]
    plan = last_range(log, "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filter_does_not_repeat_the_extraction(spark):
    df = spark.createDataFrame([("x",)], "raw string")
    shown = apply_rules(parse(df, BRACKETED, time=False), [Rule("level", "equals", "a", "include"), Rule("module", "equals", "b", "exclude")], f)
    plan = shown.select(f("message"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.index("Filter") < plan.index("Generate explode")
