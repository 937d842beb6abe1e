"""Include and exclude rules compiled to one boolean column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from brackenlog.functions.regex import PatternError, matches
from brackenlog.functions.text import contains_ignore_case
from brackenlog.functions.timefmt import parse_datetime, time_literal
from brackenlog.operators.extract import Lookup

TIME_FIELDS = ("timestamp", "time", "ts")
INCLUDE, EXCLUDE = "include", "exclude"


@dataclass(frozen=True)
class Rule:
    field: str
    op: str = "contains"  # equals, contains, regex, range
    value: str = ""
    action: str = EXCLUDE
    log_schema: str | None = None
    enabled: bool = True
    origin: str | None = None  # where it was picked from; not part of its identity

    @property
    def is_time_range(self) -> bool:
        return self.op == "range" and self.field in TIME_FIELDS

    @property
    def identity(self) -> tuple:
        return (self.log_schema, self.field, self.op, self.value, self.action, self.enabled)

    @property
    def bounds(self) -> tuple[str, str]:
        low, _, high = self.value.partition("..")
        return low, high


def within(ts: Column, low, high) -> Column:
    """Inclusive time range with open ends; an entry without a time is outside."""
    hit = ts.isNotNull()
    if low is not None:
        hit = hit & (ts >= time_literal(low))
    if high is not None:
        hit = hit & (ts <= time_literal(high))
    return F.coalesce(hit, F.lit(False))


def condition(rule: Rule, fields: Lookup) -> Column:
    """Whether the rule hits an entry, leaving its schema scope aside."""
    low, high = rule.bounds
    if rule.is_time_range:
        return within(F.col("ts"), parse_datetime(low), parse_datetime(high))
    value = fields(rule.field)
    if rule.op == "range":
        hit = F.lit(True)
        if low:
            hit = hit & (value >= low)
        if high:
            hit = hit & (value <= high)
        return hit
    if rule.op == "equals":
        return value == rule.value
    if rule.op == "contains":
        return contains_ignore_case(value, rule.value)
    if rule.op == "regex":
        try:
            return matches(value, rule.value)
        except PatternError:
            return F.lit(False)
    return F.lit(False)


def applies(rule: Rule) -> Column | None:
    """Scope of a rule; None when it covers every schema."""
    scope = (rule.log_schema or "").strip()
    return F.col("schema_name") == scope if scope else None


def hits(rule: Rule, fields: Lookup) -> Column:
    scope, hit = applies(rule), condition(rule, fields)
    return hit if scope is None else scope & hit


# Cheap tests go first: Spark stops at the first that decides.
_COST = {"equals": 0, "range": 1, "contains": 2, "regex": 3}


def visible(rules: Sequence[Rule], fields: Lookup) -> Column:
    """Includes are alternatives, any exclude hides, and an entry no include covers stays."""
    active = sorted((r for r in rules if r.enabled), key=lambda r: _COST.get(r.op, 3))
    includes = [r for r in active if r.action == INCLUDE]
    excludes = [r for r in active if r.action == EXCLUDE]
    keep = F.lit(True)
    if includes:
        kept = _any([hits(r, fields) for r in includes])
        scopes = [applies(r) for r in includes]
        everywhere = any(scope is None for scope in scopes)
        keep = kept if everywhere else kept | ~_any(scopes)
    if excludes:
        keep = keep & ~_any([hits(r, fields) for r in excludes])
    return keep


def apply_rules(df: DataFrame, rules: Sequence[Rule], fields: Lookup) -> DataFrame:
    return df.filter(visible(rules, fields)) if any(r.enabled for r in rules) else df


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = out | column
    return out


# ---- editing a rule list ------------------------------------------------------------


def add(rules: Sequence[Rule], rule: Rule) -> list[Rule]:
    """Append, except that a time range takes the place of every earlier one."""
    if not rule.is_time_range:
        return [*rules, rule]
    at = next((i for i, r in enumerate(rules) if r.is_time_range), len(rules))
    kept = [r for r in rules if not r.is_time_range]
    at = min(at, len(kept))
    return [*kept[:at], rule, *kept[at:]]


def one_time_range(rules: Sequence[Rule]) -> list[Rule]:
    """Keep only the newest of several time ranges."""
    ranges = [i for i, r in enumerate(rules) if r.is_time_range]
    return [r for i, r in enumerate(rules) if not r.is_time_range or i == ranges[-1]]


def like_row(row, dimension: str, keyword: str = "", action: str = EXCLUDE) -> Rule:
    """A rule from a chosen row: its value of a field, or a keyword in the message."""
    if dimension == "keyword":
        return Rule("message", "contains", keyword, action)
    return Rule(dimension, "equals", row[dimension], action)


def hide_like(df: DataFrame, examples: DataFrame, field: Column, keep: bool = False) -> DataFrame:
    """Hide (or keep) every entry whose field equals one of the example values."""
    values = examples.select(F.col(examples.columns[0]).alias("_example")).distinct()
    return df.join(values, field == F.col("_example"), "left_semi" if keep else "left_anti")


# ---- rules held in a table ----------------------------------------------------------

RULE_SCHEMA = (
    "position int, log_schema string, field string, op string, value string, "
    "action string, enabled boolean, origin string"
)


def to_table(spark, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (i, r.log_schema, r.field, r.op, r.value, r.action, r.enabled, r.origin)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def from_table(rules: DataFrame) -> list[Rule]:
    """A rule list is configuration: small, and needed on the driver to build columns."""
    rows = rules.orderBy("position").collect()
    return [
        Rule(r.field, r.op, r.value, r.action, r.log_schema, r.enabled, r.origin) for r in rows
    ]


def newest_time_range(rules: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """``one_time_range`` for a table of rule sets, one set per key."""
    is_time = (F.col("op") == "range") & F.col("field").isin(*TIME_FIELDS)
    ranges = rules.filter(is_time)
    last = Window.partitionBy(*key, F.lit(True)).orderBy(F.desc("position"))
    newest = ranges.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")
    return rules.filter(~is_time).unionByName(newest)


def distinct_rules(rules: DataFrame) -> DataFrame:
    """Union without duplicates: same scope, field, op, value, action and switch."""
    identity = ["log_schema", "field", "op", "value", "action", "enabled"]
    first = F.min_by(F.struct("position", "origin"), "position").alias("_first")
    return rules.groupBy(*identity).agg(first).select("_first.position", *identity, "_first.origin")
