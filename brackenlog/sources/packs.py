"""Libraries of schemas, rules and searches kept as one JSON file per item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brackenlog.plans.rules import Rule
from brackenlog.plans.schema import DEFAULT_TIME_FORMAT, LogSchema, Sample

_SCHEMA = (
    "struct<name string, description string, format string, timestamp_field string, "
    "timestamp_format string, field_patterns map<string,string>, entry_start string, "
    "entry_end string, samples array<struct<line string, level string>>>"
)
_RULE = (
    "struct<log_schema string, field string, op string, value string, action string, enabled boolean>"
)

# The tiers a library item can come from, first wins.
TIERS = ("project", "user", "hub", "bundled")


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.option("wholetext", "true")
        .option("pathGlobFilter", "*.json")
        .text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    )


def schema_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Schemas of a folder, each wrapped as ``{name, description, schema}`` or bare."""
    wrapped = F.from_json("body", f"struct<name string, description string, schema {_SCHEMA}>")
    bare = F.from_json("body", _SCHEMA)
    found = F.coalesce(F.when(wrapped["schema"]["format"].isNotNull(), wrapped["schema"]), bare)
    return _bodies(spark, folder).select("path", found.alias("_s")).select("path", "_s.*")


def rule_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of a folder, each wrapped as ``{name, description, filter}`` or bare."""
    wrapped = F.from_json("body", f"struct<name string, description string, filter {_RULE}>")
    bare = F.from_json("body", _RULE)
    rule = F.coalesce(F.when(wrapped["filter"]["field"].isNotNull(), wrapped["filter"]), bare)
    return (
        _bodies(spark, folder)
        .select("path", wrapped["name"].alias("name"), wrapped["description"].alias("description"), rule.alias("_r"))
        .select(
            "path",
            "name",
            "description",
            "_r.log_schema",
            "_r.field",
            F.coalesce("_r.op", F.lit("contains")).alias("op"),
            F.coalesce("_r.value", F.lit("")).alias("value"),
            F.coalesce("_r.action", F.lit("exclude")).alias("action"),
            F.coalesce("_r.enabled", F.lit(True)).alias("enabled"),
        )
    )


def search_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Searches of a folder, each ``{name, description, query}`` or just the query text."""
    whole = F.from_json("body", "struct<name string, description string, query string>")
    text = F.from_json(F.concat(F.lit('{"query":'), "body", F.lit("}")), "struct<query string>")["query"]
    bare = whole["query"].isNull()
    named = F.concat(
        F.lit("search-001-"),
        F.when(F.length(text) > 64, F.concat(F.substring(text, 1, 64), F.lit("..."))).otherwise(text),
    )
    return _bodies(spark, folder).select(
        "path",
        F.when(bare, named).otherwise(whole["name"]).alias("name"),
        F.coalesce(F.when(~bare, whole["description"]), F.lit("")).alias("description"),
        F.when(bare, text).otherwise(whole["query"]).alias("query"),
    )


def load_schemas(pack: DataFrame) -> list[LogSchema]:
    """Schema objects of a pack: configuration, needed on the driver to build columns."""
    return [
        LogSchema(
            name=r.name,
            template=r.format,
            time_format=r.timestamp_format or DEFAULT_TIME_FORMAT,
            time_field=r.timestamp_field or "timestamp",
            field_patterns=dict(r.field_patterns or {}),
            entry_start=r.entry_start or "",
            entry_end=r.entry_end or "",
            samples=tuple(Sample(s.line, s.level) for s in r.samples or ()),
            description=r.description or "",
        )
        for r in pack.orderBy("path").collect()
    ]


def load_rules(pack: DataFrame) -> list[Rule]:
    return [
        Rule(r.field, r.op, r.value, r.action, r.log_schema, r.enabled)
        for r in pack.orderBy("path").collect()
    ]


def tiered(packs: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Packs stacked in tier order. Rules and searches of all tiers stay on offer."""
    out = None
    for rank, (origin, pack) in enumerate(packs):
        df = pack.withColumns({"origin": F.lit(origin), "tier": F.lit(rank)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def first_by_name(library: DataFrame) -> DataFrame:
    """For schemas the first tier that has a name wins."""
    order = Window.partitionBy("name").orderBy("tier", "path")
    return library.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
