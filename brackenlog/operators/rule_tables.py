"""Rules held in a table and joined to the entries as data, however many there are.

``hits`` and ``visible`` in ``plans.rules`` make a column of every rule, which suits a list that
a person wrote. Here a rule is a row of ``RULE_SCHEMA`` and nothing is collected. Rules that ask
the same are one *test*, and tests meet the distinct values of a field, not entries:

* ``equals`` is a hash join on scope, field and value;
* ranges of text or time are ends sorted among the values: a running sum over both, cut into
  ranges of equal size, counts what lies between two ends or tells which values lie inside any;
* ``contains`` joins on the rarest run of ``GRAM`` characters of what is looked for, then looks;
* ``regex``, and shorter ``contains``, have no key, so values are cut into blocks by their number
  and every block meets the tests of its field, a pattern at a time over a whole block.

So all but the last grow with rules and values, not with their product.

A rule on a field outside ``names`` reads an empty value, as ``Lookup`` has it for unknown names.
Repeated positions are separate rules to ``apply_table`` and one to ``table_hits``. Rules that
are switched off, or have an unknown op or a pattern that the dialect rejects, hit nothing.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from brackenlog.functions.regex import PatternError, to_java
from brackenlog.functions.timefmt import parse_datetime_col
from brackenlog.operators.extract import Lookup
from brackenlog.plans.rules import EXCLUDE, INCLUDE, TIME_FIELDS
from brackenlog.session import fresh_dir, shuffle_width

#: Distinct values of a block that is held against all patterns of its field.
BLOCK_VALUES = 20_000
#: Characters of a run that text and what it should contain are joined on.
GRAM = 3
#: What makes two rules one test; the scope is empty for all schemas.
TEST = ["scope", "field", "op", "wanted", "timed"]


def _stored(df: DataFrame, label: str) -> DataFrame:
    folder = fresh_dir(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


@F.pandas_udf(StringType())
def _java(patterns: pd.Series) -> pd.Series:
    def one(pattern):
        try:
            return to_java(pattern)
        except PatternError:
            return None

    return patterns.map(one)


def _folded(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _active(rules: DataFrame, names: Sequence[str]) -> DataFrame:
    known = F.col("field").isin(*names, *TIME_FIELDS)
    value = F.coalesce("value", F.lit(""))
    cut = F.instr(value, "..")
    scope = F.trim(F.coalesce("log_schema", F.lit("")))
    return rules.where("enabled").select(
        "position",
        scope.alias("scope"),
        F.when(known, F.col("field")).otherwise("").alias("field"),
        "op",
        value.alias("wanted"),
        "action",
        F.when(cut > 0, F.substring(value, F.lit(1), cut - 1)).otherwise(value).alias("low"),
        F.when(cut > 0, F.substring(value, cut + 2, F.length(value))).otherwise("").alias("high"),
        ((F.col("op") == "range") & F.col("field").isin(*TIME_FIELDS)).alias("timed"),
    )


def _values(df: DataFrame, fields: Lookup, names: Sequence[str]) -> Column:
    cells = [F.struct(F.lit(n).alias("field"), fields(n).alias("value")) for n in dict.fromkeys([*names, *TIME_FIELDS])]
    return F.array(*cells, F.struct(F.lit("").alias("field"), F.lit("").alias("value")))


def _tests(rules: DataFrame) -> DataFrame:
    return rules.select(*TEST, "low", "high").distinct()


def _scoped(values: DataFrame, tests: DataFrame) -> DataFrame:
    """Values once for every scope they are tested under, those of untested fields left out."""
    scopes = F.array_distinct(F.array_compact(F.array(F.lit(""), F.col("schema_name"))))
    return values.withColumn("scope", F.explode(scopes)).join(tests.select("scope", "field").distinct(), ["scope", "field"], "left_semi")


# ---- equals, contains, regex --------------------------------------------------------


def _pairs(values: DataFrame, tests: DataFrame) -> DataFrame:
    """``TEST, schema_name, value, n`` for all values that equal, contain or match what is wanted."""
    out = [*TEST, "schema_name", "value", "n"]
    equal = tests.where("op = 'equals'").withColumn("value", F.col("wanted"))
    found = _scoped(values, equal).join(equal, ["scope", "field", "value"]).select(out)
    ascii_only = F.col("wanted").rlike(r"(?s)\A\p{ASCII}*\z")
    needle = F.when(ascii_only, _folded(F.col("wanted"))).otherwise(F.lower("wanted"))
    # The dialect is translated where a rule is read, once, not where it is tested.
    patterns = tests.where("op IN ('contains', 'regex')").select(*TEST, ascii_only.alias("ascii_only"), F.when(F.col("op") == "contains", needle).otherwise(_java("wanted")).alias("pattern"))
    patterns = _stored(patterns.where("pattern IS NOT NULL"), "rule-patterns")
    keyed = (F.col("op") == "contains") & (F.length("pattern") >= GRAM)
    values = _stored(_scoped(values, patterns), "pattern-values")
    return found.unionByName(_containing(values, patterns.where(keyed)).select(out)).unionByName(_matching(values, patterns.where(~keyed)).select(out))


def _grams(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1)))


def _containing(values: DataFrame, needles: DataFrame) -> DataFrame:
    held = ["scope", "field", "ascii_only"]
    text = F.when(F.col("ascii_only"), _folded(F.col("value"))).otherwise(F.lower("value"))
    texts = values.join(needles.select(held).distinct(), ["scope", "field"]).withColumn("text", text)
    runs = needles.withColumn("gram", F.explode(_grams("pattern")))
    # How common each run is among the values decides which of its runs a needle is found by.
    common = texts.select(*held, F.explode(_grams("text")).alias("gram")).join(runs.select(*held, "gram").distinct(), [*held, "gram"], "left_semi")
    common = common.groupBy(*held, "gram").agg(F.count(F.lit(1)).alias("values"))
    rarest = F.min_by("gram", F.struct(F.coalesce("values", F.lit(0)).alias("values"), "gram")).alias("gram")
    chosen = _stored(runs.join(common, [*held, "gram"], "left").groupBy(*TEST, "ascii_only", "pattern").agg(rarest), "needles")
    found = texts.withColumn("gram", F.explode(_grams("text"))).join(chosen, [*held, "gram"])
    return found.where(F.contains("text", F.col("pattern")))


def _matching(values: DataFrame, patterns: DataFrame) -> DataFrame:
    values = _scoped(values.drop("scope").distinct(), patterns)
    blocks = max(1, -(-values.count() // BLOCK_VALUES))
    dealt = values.withColumn("block", F.pmod(F.xxhash64("schema_name", "field", "value"), F.lit(blocks)).cast("int"))
    patterns = patterns.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    holds = F.when(F.col("ascii_only"), F.contains(_folded(F.col("value")), F.col("pattern"))).otherwise(F.contains(F.lower("value"), F.col("pattern")))
    # A merge join holds a pattern against one value after another, and this function keeps the
    # last pattern compiled, where the others compile it for every value.
    found = F.when(F.col("op") == "contains", holds).otherwise(F.regexp_instr("value", F.col("pattern")) > 0)
    return patterns.hint("merge").join(dealt, ["scope", "field", "block"]).where(found)


# ---- ranges -------------------------------------------------------------------------


def _text_ranges(tests: DataFrame) -> DataFrame:
    ranges = tests.where("NOT timed AND op = 'range' AND (high = '' OR low <= high)")
    return ranges.select(*TEST, *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("low", "high")])


def _time_ranges(tests: DataFrame) -> DataFrame:
    ends = {c: parse_datetime_col(F.col(c)) for c in ("low", "high")}
    # Reading a time is a long expression, which every later use of the column would repeat.
    read = _stored(tests.where("timed").withColumns(ends), "time-ranges")
    return read.where("low IS NULL OR high IS NULL OR low <= high")


def _of_times(times: DataFrame) -> DataFrame:
    """Times as values of every name that a range may call them by."""
    return times.withColumn("field", F.explode(F.array(*[F.lit(n) for n in TIME_FIELDS])))


def _ends(ranges: DataFrame, low_n: int, high_n: int) -> DataFrame:
    """Both ends of every range: a low end sorts before equal values, a high end behind them."""
    low = F.struct(F.when(F.col("low").isNull(), -1).otherwise(0).alias("edge"), F.col("low").alias("at"), F.lit(0).alias("kind"), F.lit(low_n).cast("long").alias("n"))
    high = F.struct(F.when(F.col("high").isNull(), 1).otherwise(0).alias("edge"), F.col("high").alias("at"), F.lit(2).alias("kind"), F.lit(high_n).cast("long").alias("n"))
    return ranges.select(*TEST, F.inline(F.array(low, high)))


def _running(values: DataFrame, ends: DataFrame) -> DataFrame:
    """Values and ends with the sum ``c`` of ``n`` up to each, per scope and field.

    Both are sorted into as many ranges as there are shuffle partitions; what comes before a
    range is one sum for each of its fields.
    """
    values = values.withColumns({"edge": F.lit(0), "kind": F.lit(1)})
    points = ends.unionByName(values, allowMissingColumns=True)
    group, order = ["scope", "field"], ["edge", "at", "kind"]
    ranged = points.repartitionByRange(shuffle_width(points.sparkSession), *group, *order, "wanted")
    ranged = _stored(ranged.withColumn("part", F.spark_partition_id()), "points")
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(*group, "part").agg(F.sum("n").alias("total")).select(*group, "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    here = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(base, [*group, "part"]).withColumn("c", F.col("base") + F.sum("n").over(here))


def _between(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """``TEST, hits``: the sum of ``n`` of the values ``at`` that lie in each range."""
    summed = _running(_scoped(values, ranges), _ends(ranges, 0, 0)).where("kind <> 1")
    return summed.groupBy(*TEST).agg(F.sum(F.when(F.col("kind") == 2, F.col("c")).otherwise(-F.col("c"))).alias("hits"))


def _covered(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """The values ``at`` that lie in any range."""
    inside = _scoped(values, ranges).withColumn("n", F.lit(0).cast("long"))
    return _running(inside, _ends(ranges, 1, -1)).where("kind = 1 AND c > 0")


def table_hits(df: DataFrame, rules: DataFrame, fields: Lookup, names: Sequence[str]) -> DataFrame:
    """``position, action, hits`` of every rule: the entries of ``df`` it hits, leaving the others aside.

    ``df`` has ``schema_name`` and ``ts`` besides the fields. Values and times are counted before
    they meet a rule.
    """
    active = _stored(_active(rules, names), "rules")
    tests = _stored(_tests(active), "tests")
    cells = df.select("schema_name", F.inline(_values(df, fields, names))).join(tests.where("NOT timed").select("field").distinct(), "field", "left_semi")
    values = _stored(cells.groupBy("schema_name", "field", "value").agg(F.count(F.lit(1)).alias("n")), "field-values")
    times = _stored(df.where("ts IS NOT NULL").groupBy("schema_name", F.col("ts").alias("at")).agg(F.count(F.lit(1)).alias("n")), "times")
    counts = _pairs(values, tests.where("NOT timed")).groupBy(*TEST).agg(F.sum("n").alias("hits"))
    counts = counts.unionByName(_between(values.withColumnRenamed("value", "at"), _text_ranges(tests)))
    counts = counts.unionByName(_between(_of_times(times), _time_ranges(tests)))
    total = active.join(counts, TEST).groupBy("position").agg(F.sum("hits").alias("hits"))
    return rules.select("position", "action").join(total, "position", "left").select("position", "action", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def apply_table(df: DataFrame, rules: DataFrame, fields: Lookup, names: Sequence[str], key: str) -> DataFrame:
    """The entries of ``df`` that ``visible`` would show under all ``rules``; ``key`` is unique in ``df``.

    Only keys and distinct values travel for the decision.
    """
    active = _stored(_active(rules, names), "rules")
    cells = df.select(key, "schema_name", F.inline(_values(df, fields, names)))
    # The field without a name stands for the entry itself.
    tested = active.where("NOT timed").select("field").unionByName(df.sparkSession.createDataFrame([("",)], "field string")).distinct()
    cells = _stored(cells.join(tested, "field", "left_semi").select(key, "schema_name", "field", "value"), "cells")
    values = _stored(cells.groupBy("schema_name", "field", "value").agg(F.count(F.lit(1)).alias("n")), "field-values")
    times = _stored(df.where("ts IS NOT NULL").select(key, "schema_name", F.col("ts").alias("at")), "times")

    def hit(action: str) -> DataFrame:
        tests = _stored(_tests(active.where(F.col("action") == action)), "tests")
        ranged = _covered(values.withColumnRenamed("value", "at"), _text_ranges(tests)).withColumnRenamed("at", "value")
        same = ["schema_name", "field", "value"]
        found = _pairs(values, tests.where("NOT timed")).select(same).unionByName(ranged.select(same))
        keys = cells.join(found.distinct(), same, "left_semi").select(key)
        inside = _covered(_of_times(times.select("schema_name", "at").distinct()), _time_ranges(tests)).select("schema_name", "at").distinct()
        at = (F.col("v.at") == F.col("r.at")) & F.col("v.schema_name").eqNullSafe(F.col("r.schema_name"))
        return keys.unionByName(times.alias("v").join(inside.alias("r"), at, "left_semi").select(key))

    includes = active.where(F.col("action") == INCLUDE).select("scope").distinct()
    # An entry that no include covers stays: all of them if there is none, none if one has no scope.
    entries = cells.where("field = ''")
    covered = entries.alias("v").join(includes.where("scope <> ''"), F.col("v.schema_name") == F.col("scope"), "left_semi").select(key)
    everywhere = _stored(includes.agg(F.coalesce(F.bool_or(F.col("scope") == ""), F.lit(False)).alias("everywhere")), "scopes").scalar()
    free = entries.select(key).distinct().join(covered, key, "left_anti").where(~everywhere)
    kept = hit(INCLUDE).unionByName(free).distinct().join(hit(EXCLUDE), key, "left_anti")
    return df.join(kept, key, "left_semi")
