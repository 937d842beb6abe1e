"""Counts and summaries of a view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brackenlog.functions.regex import to_java
from brackenlog.operators.extract import Lookup
from brackenlog.plans.rules import Rule, hits
from brackenlog.plans.search import compile_search


def count_matches(df: DataFrame, text: str, fields: Lookup) -> DataFrame:
    condition = compile_search(text, fields).condition
    return df.agg(F.count_if(condition).alias("matches"))


def level_breakdown(df: DataFrame, fields: Lookup) -> DataFrame:
    return df.groupBy(fields("level").alias("level")).agg(F.count(F.lit(1)).alias("entries"))


def top_values(df: DataFrame, value: Column, k: int) -> DataFrame:
    counted = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("entries"))
    return counted.orderBy(F.desc("entries"), "value").limit(k)


def timeline(df: DataFrame, key: Column, buckets: int) -> DataFrame:
    """Entries per time bucket and key, over the span of the view; bucket 0 is the oldest.

    The span is one row, found by a sub-query; timeless entries have no bucket.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = df.select(F.struct(F.min(us).alias("lo"), F.max(us).alias("hi"))).scalar()
    lo, hi = span["lo"], span["hi"]
    bucket = F.when(lo == hi, 0).otherwise(
        F.least(F.width_bucket(us, lo, hi, F.lit(buckets)), F.lit(buckets)) - 1
    )
    return (
        df.filter(F.col("ts").isNotNull())
        .groupBy(bucket.cast("int").alias("bucket"), key.alias("key"))
        .agg(F.count(F.lit(1)).alias("entries"))
    )


def rule_preview(df: DataFrame, rule: Rule, fields: Lookup) -> DataFrame:
    """How many of the shown entries a rule would hit."""
    return df.agg(F.count_if(hits(rule, fields)).alias("hits"), F.count(F.lit(1)).alias("shown"))


def preview_rows(df: DataFrame, rule: Rule, fields: Lookup, k: int, *order) -> DataFrame:
    """The first few entries a rule would hit."""
    return df.filter(hits(rule, fields)).orderBy(*order).limit(k)


def source_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "schema_name").agg(
        F.count(F.lit(1)).alias("entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def log_span(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def pattern_hits(df: DataFrame, text: Column, patterns: Mapping[str, str]) -> DataFrame:
    """Entries each pattern matches, all counted in one pass; one row per pattern."""
    counts = df.agg(
        *[F.count_if(text.rlike(to_java(p))).alias(f"c{i}") for i, p in enumerate(patterns.values())]
    )
    rows = [
        F.struct(F.lit(name).alias("name"), F.col(f"c{i}").alias("hits"))
        for i, name in enumerate(patterns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def rule_hits(df: DataFrame, rules: Sequence[Rule], fields: Lookup) -> DataFrame:
    """Entries each rule hits, one row per rule, in one pass."""
    counts = df.agg(*[F.count_if(hits(r, fields)).alias(f"c{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(r.action).alias("action"), F.col(f"c{i}").alias("hits")
        )
        for i, r in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*rows)))


def with_rule_hits(df: DataFrame, rules: Sequence[Rule], fields: Lookup) -> DataFrame:
    """Positions of the rules that hit each entry."""
    found = [F.when(hits(r, fields), F.lit(i)) for i, r in enumerate(rules)]
    return df.withColumn("rule_positions", F.array_compact(F.array(*found)))
