"""Rules joined as data against the same rules as columns."""

import random

from pyspark.sql import functions as F

from brackenlog.operators.extract import Lookup
from brackenlog.operators.rule_tables import apply_table, table_hits
from brackenlog.operators.stats import rule_hits
from brackenlog.plans.builtin import BRACKETED, GENERIC
from brackenlog.plans.rules import RULE_SCHEMA, Rule, apply_rules, to_table

f = Lookup([BRACKETED, GENERIC])
NAMES = ["level", "module", "message", "thread"]


def entries(spark, n=300):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        fields = {"log_level": rng.choice(["Error", "Trace", ""]), "log_module": rng.choice("ABé"), "thread_id": str(rng.randrange(40)), "message": rng.choice(["", "Kelvin K", "ÄRGER am Morgen", f"job {k} done", "a.b"])}
        time = None if k % 9 == 0 else f"2024-02-{1 + k % 5:02d} {k % 24:02d}:00:00"
        rows.append((k, rng.choice([BRACKETED.name, GENERIC.name, "other"]), fields, time))
    names = list(dict.fromkeys([*BRACKETED.fields, *GENERIC.fields]))
    shape = ", ".join(f"{n}: string" for n in names)
    rows = [(k, schema, {n: fields.get(n) for n in names}, time) for k, schema, fields, time in rows]
    df = spark.createDataFrame(rows, f"k long, schema_name string, fields struct<{shape}>, time string")
    return df.withColumn("ts", F.col("time").cast("timestamp_ntz")).withColumn("raw", F.lit(""))


RULES = [
    Rule("level", "equals", "Error", "include"), Rule("thread", "equals", "7", "include"), Rule("thread", "equals", "nothing", "include"),
    Rule("message", "contains", "KELVIN K", "include"), Rule("message", "contains", "ärger", "exclude"), Rule("message", "contains", "", "include", BRACKETED.name),
    Rule("message", "regex", r"job \d*3 ", "exclude"), Rule("message", "regex", "(unclosed", "exclude"), Rule("message", "regex", r"^a\.b$", "include"),
    Rule("thread", "range", "12..19", "exclude", GENERIC.name), Rule("thread", "range", "..1", "include"), Rule("module", "range", "B..", "include"), Rule("thread", "range", "9..1", "exclude"),
    Rule("timestamp", "range", "2024-02-01 05:00..2024-02-03 04:00", "include"), Rule("ts", "range", "2024-02-05..nonsense", "exclude"), Rule("time", "range", "..", "include", "other"),
    Rule("level", "equals", "Trace", "exclude", enabled=False), Rule("nosuch", "equals", "", "include", "other"), Rule("nosuch", "equals", "x", "exclude"), Rule("level", "near", "x", "exclude"),
]


def test_hits_equal_those_of_columns(spark, monkeypatch):
    monkeypatch.setattr("brackenlog.operators.rule_tables.BLOCK_VALUES", 50)
    df = entries(spark)
    want = {r.position: r.hits if RULES[r.position].enabled else 0 for r in rule_hits(df, RULES, f).collect()}
    got = {r.position: r.hits for r in table_hits(df, to_table(spark, RULES), f, NAMES).collect()}
    assert got == want and sum(n > 0 for n in want.values()) > 10


def test_shown_entries_equal_those_of_columns(spark):
    df = entries(spark, 200)
    scoped = [r for r in RULES if r.log_schema or r.action == "exclude"]
    for rules in (RULES, scoped, []):
        want = sorted(r.k for r in apply_rules(df, rules, f).collect())
        assert sorted(r.k for r in apply_table(df, to_table(spark, rules) if rules else spark.createDataFrame([], RULE_SCHEMA), f, NAMES, "k").collect()) == want


def test_no_entries(spark):
    df = entries(spark, 5).where("k < 0")
    assert {r.hits for r in table_hits(df, to_table(spark, RULES), f, NAMES).collect()} == {0}
    assert apply_table(df, to_table(spark, RULES), f, NAMES, "k").isEmpty()


def test_rules_that_ask_the_same_are_one_test(spark, monkeypatch):
    from brackenlog.operators import rule_tables

    rng = random.Random(8)
    kinds = [("message", "contains", "b "), ("message", "contains", "JOB 1"), ("message", "regex", r"\d{2}"), ("thread", "range", "1..2"), ("ts", "range", "2024-02-02 03:00..2024-02-03 04:00"), ("level", "equals", "Error")]
    rules = [Rule(*rng.choice(kinds), "include", rng.choice([None, GENERIC.name])) for _ in range(60)]
    held, stored = {}, rule_tables._stored
    monkeypatch.setattr(rule_tables, "_stored", lambda df, label: held.update({label: stored(df, label)}) or held[label])
    df = entries(spark, 100)
    got = {r.position: r.hits for r in table_hits(df, to_table(spark, rules), f, NAMES).collect()}
    assert got == {r.position: r.hits for r in rule_hits(df, rules, f).collect()}
    assert held["rule-patterns"].count() <= 6
