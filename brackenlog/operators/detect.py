"""Which schemas a source is written in, found from its first lines, for all sources at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brackenlog.functions.text import is_blank
from brackenlog.operators.extract import _pick
from brackenlog.operators.fold import fold_sample
from brackenlog.plans.builtin import BRACKETED, GENERIC
from brackenlog.plans.schema import LogSchema


def by_specificity(candidates: Sequence[LogSchema]) -> list[LogSchema]:
    return sorted(candidates, key=lambda s: (-s.specificity, s.name))


def coverage(sample: DataFrame, candidates: Sequence[LogSchema]) -> DataFrame:
    """Entries each candidate would make of a sample, and how many of them it parses.

    ``sample`` holds ``source, line_no, value``: a few hundred lines per source.
    """
    candidates = list(candidates)
    tried = sample.withColumn("_rank", F.explode(F.array(*[F.lit(i) for i in range(len(candidates))])))
    rank = F.col("_rank")
    entries = fold_sample(tried, [[s] for s in candidates], ["source", "_rank"], rank)
    filled = ~is_blank(F.col("raw"))
    parsed = _pick(rank, [s.parses(F.col("raw")) for s in candidates])
    return entries.groupBy("source", "_rank").agg(
        F.count_if(filled & parsed).alias("matched"), F.count_if(filled).alias("total")
    ).withColumn("schema_name", _pick(rank, [F.lit(s.name) for s in candidates]))


def detect_single(sample: DataFrame, candidates: Sequence[LogSchema]) -> DataFrame:
    """The most specific schema that parses a quarter of the entries it makes."""
    found = coverage(sample, by_specificity(candidates)).filter(
        (F.col("matched") > 0) & (F.col("matched") * 4 >= F.col("total"))
    )
    return found.groupBy("source").agg(F.min_by("schema_name", "_rank").alias("schema_name"))


def _sets(sample: DataFrame, candidates: Sequence[LogSchema]) -> DataFrame:
    """``source, schemas`` of every source; empty where no schema wins a fifth of the lines."""
    ordered = by_specificity([s for s in candidates if s.name != GENERIC.name])
    line = F.col("value")
    first = F.coalesce(*[F.when(s.parses(line), i) for i, s in enumerate(ordered)], F.lit(-1))
    filled = ~is_blank(line)
    ranked = sample.select("source", filled.alias("_filled"), F.when(filled, first).alias("_rank"))
    counts = ranked.groupBy("source").agg(
        F.count_if("_filled").alias("_lines"),
        *[F.count_if(F.col("_rank") == i).alias(f"_c{i}") for i in range(len(ordered))],
    )
    winners = [
        F.when((F.col(f"_c{i}") > 0) & (F.col(f"_c{i}") * 5 >= F.col("_lines")), F.lit(s.name))
        for i, s in enumerate(ordered)
    ]
    return counts.select("source", F.array_compact(F.array(*winners)).alias("schemas"))


def detect_set(sample: DataFrame, candidates: Sequence[LogSchema]) -> DataFrame:
    """Schemas that are the best match of a fifth of the lines, most specific first."""
    return _sets(sample, candidates).filter(F.size("schemas") > 0)


def detect_schemas(
    sample: DataFrame, candidates: Sequence[LogSchema], default: LogSchema = BRACKETED
) -> DataFrame:
    """``source, schemas``: the set, else the single best, else the default."""
    several = _sets(sample, candidates)
    # Folding under every candidate is for the sources that need it only.
    open_sources = several.filter(F.size("schemas") == 0).select("source")
    single = detect_single(sample.join(open_sources, "source", "left_semi"), candidates)
    found = F.coalesce("schema_name", F.lit(default.name))
    return several.join(single, "source", "left").select(
        "source", F.when(F.size("schemas") > 0, F.col("schemas")).otherwise(F.array(found)).alias("schemas")
    )


def heal(assigned: DataFrame, sample: DataFrame, candidates: Sequence[LogSchema]) -> DataFrame:
    """Replace an assigned schema (``source, schema_name``) that parses no entry of its source."""
    scores = coverage(sample, candidates).select("source", "schema_name", "matched", "total")
    better = detect_single(sample, candidates).withColumnRenamed("schema_name", "better")
    explains = (F.col("matched") > 0) | F.coalesce(F.col("total") == 0, F.lit(False))
    return (
        assigned.join(scores, ["source", "schema_name"], "left")
        .join(better, "source", "left")
        .select(
            "source",
            F.when(F.coalesce(explains, F.lit(False)), F.col("schema_name"))
            .otherwise(F.coalesce("better", "schema_name"))
            .alias("schema_name"),
        )
    )


def schema_sets(detected: DataFrame, candidates: Sequence[LogSchema]) -> tuple[DataFrame, list[list[int]]]:
    """Number the distinct sets. The sets come to the driver: there are at most as many as
    combinations of library schemas that occur, and columns must be built from them."""
    place = {s.name: i for i, s in enumerate(candidates)}
    found = [r.schemas for r in detected.select("schemas").distinct().orderBy("schemas").collect()]
    number: Column = F.lit(0)
    for i, names in enumerate(found[1:], 1):
        number = F.when(F.col("schemas") == F.array(*[F.lit(n) for n in names]), i).otherwise(number)
    return detected.select("source", number.alias("schema_set")), [[place[n] for n in s] for s in found]
