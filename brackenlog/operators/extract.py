"""Entries to fields: which schema parses an entry, its fields and its event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brackenlog.functions.text import head_line
from brackenlog.functions.timefmt import parse_time, sniff_time
from brackenlog.plans.schema import ORIGIN, WHOLE_ENTRY, LogSchema

Schemas = LogSchema | Sequence[LogSchema]


def as_list(schemas: Schemas) -> list[LogSchema]:
    return [schemas] if isinstance(schemas, LogSchema) else list(schemas)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed exactly once per row.

    A plain projection is merged into every filter above it, and a regex pass would run
    again for each mention of a field. A one-element explode is a boundary for that.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def schema_index(raw: Column, schemas: Sequence[LogSchema]) -> Column:
    """Position of the schema an entry belongs to: the first whose start probe and template
    match, else the first whose template matches, else the primary one."""
    if len(schemas) < 2:
        return F.lit(0)
    head = head_line(raw)
    probed = [F.when(s.starts(head) & s.parses(raw), i) for i, s in enumerate(schemas)]
    parsed = [F.when(s.parses(raw), i) for i, s in enumerate(schemas)]
    return F.coalesce(*probed, *parsed, F.lit(0))


def parse(
    entries: DataFrame,
    schemas: Schemas,
    sets: Sequence[Sequence[int]] | None = None,
    wanted: Sequence[str] | None = None,
    time: bool = True,
    primary_only: bool = False,
) -> DataFrame:
    """Add ``schema_name``, ``fields`` (a struct of strings) and, on request, ``ts``.

    One schema or an ordered set for all entries; or, with ``sets``, an int column
    ``schema_set`` choosing one of several ordered sets of positions in ``schemas``.
    ``primary_only`` reads every entry by the first schema of its set.
    """
    schemas = as_list(schemas)
    raw = F.col("raw")
    orders = [list(range(len(schemas)))] if sets is None else [list(s) for s in sets]
    if primary_only:
        orders = [order[:1] for order in orders]

    def local(order):
        index = schema_index(raw, [schemas[i] for i in order])
        return _pick(index, [F.lit(i) for i in order])

    if sets is None:
        chosen = local(orders[0])
    else:
        chosen = _pick(F.col("schema_set"), [local(order) for order in orders])
    mixed = len(schemas) > 1
    df = once(entries, "_schema", chosen) if mixed else entries
    which = F.col("_schema") if mixed else F.lit(0)
    df = once(df, "_cells", _pick(which, [s.cells(raw, wanted) for s in schemas]))

    names = list(dict.fromkeys(n for s in schemas for n in s.kept(wanted)))
    cells = F.col("_cells")
    fields = [
        _pick(which, [s.value(cells, raw, name, wanted) for s in schemas]).alias(name) for name in names
    ]
    df = df.withColumns(
        {
            "schema_name": _pick(which, [F.lit(s.name) for s in schemas]),
            "fields": F.struct(*fields) if fields else F.struct(F.lit("").alias("message")),
        }
    )
    if time:
        df = once(df, "ts", _pick(which, [event_time(s, raw, wanted) for s in schemas]))
    return df.drop("_schema", "_cells")


def with_fields(df: DataFrame, schemas: Schemas) -> DataFrame:
    """A parsed frame whose ``fields`` hold every field of ``schemas``, null where it was not read.

    So a ``Lookup`` over the same schemas can name any of them.
    """
    read = df.schema["fields"].dataType.names
    known = dict.fromkeys([*read, *(n for s in as_list(schemas) for n in s.fields)])
    cells = [F.col("fields")[n] if n in read else F.lit(None).cast("string") for n in known]
    return df.withColumn("fields", F.struct(*(c.alias(n) for n, c in zip(known, cells))))


def event_time(schema: LogSchema, raw: Column, wanted=None) -> Column:
    """Time by the schema's format from its (logical) timestamp field, else off the line."""
    name = schema.concrete("timestamp")
    sniffed = sniff_time(raw)
    if name is None or name not in schema.kept(wanted):
        return sniffed
    text = schema.value(F.col("_cells"), raw, name, wanted)
    return F.coalesce(parse_time(text, schema.time_format), sniffed)


def _pick(which: Column, options: list[Column]) -> Column:
    out = options[-1]
    if len(options) == 1:
        return out
    case = F.when(which == 0, options[0])
    for i, option in enumerate(options[1:-1], 1):
        case = case.when(which == i, option)
    return case.otherwise(out)


class Lookup:
    """Reads a field of a parsed frame by its logical name; missing is the empty string.

    ``origin`` names the column that ``source`` reads. With ``frame`` a field that was not read
    from its entries, as after ``parse(wanted=...)``, is missing too.
    """

    def __init__(self, schemas: Schemas | None, origin: str | None = None, frame: DataFrame | None = None):
        self.schemas = [] if schemas is None else as_list(schemas)
        self.origin = origin
        self.read = None
        if frame is not None:
            self.read = frame.schema["fields"].dataType.names if "fields" in frame.columns else []

    def __call__(self, name: str) -> Column:
        if name in WHOLE_ENTRY:
            return F.col("raw")
        if name in ORIGIN:
            return F.coalesce(F.col(self.origin), F.lit("")) if self.origin else F.lit("")
        if not self.schemas:
            return F.col("raw") if name in ("message", "msg") else F.lit("")
        concrete = [s.concrete(name) for s in self.schemas]
        if len(set(concrete)) == 1:
            return self._field(concrete[0])
        case = None
        for schema, field in zip(self.schemas, concrete):
            hit = F.col("schema_name") == schema.name
            case = F.when(hit, self._field(field)) if case is None else case.when(hit, self._field(field))
        return case.otherwise("")

    def _field(self, name: str | None) -> Column:
        if name is None or (self.read is not None and name not in self.read):
            return F.lit("")
        return F.coalesce(F.col("fields")[name], F.lit(""))

    def message(self) -> Column:
        """The message, or the whole entry where it is empty."""
        found = self("message")
        return F.when(found == "", F.col("raw")).otherwise(found)


def sample_report(spark, schemas: Schemas) -> DataFrame:
    """Every sample of every schema with what it parsed to, and what is wrong with it."""
    out = None
    for schema in as_list(schemas):
        if not schema.samples:
            continue
        rows = [(schema.name, i, s.line, s.level) for i, s in enumerate(schema.samples, 1)]
        df = spark.createDataFrame(rows, "schema string, sample int, raw string, expected string")
        df = check_samples(df, schema)
        out = df if out is None else out.unionByName(df)
    return out


def check_samples(samples: DataFrame, schema: LogSchema) -> DataFrame:
    """Labelled lines (``raw``, ``expected`` level or null) against one schema."""
    level = schema.level_field
    parsed = once(samples, "_cells", schema.cells(F.col("raw")))
    found = schema.value(F.col("_cells"), F.col("raw"), level) if level else F.lit("")
    matched = F.col("raw").rlike(schema.full_pattern)
    problem = (
        F.when(~matched, "does not match the format")
        .when(F.col("expected").isNotNull() & F.lit(level is None), "the format has no level field")
        .when(F.col("expected").isNotNull() & (found != F.col("expected")), "wrong level")
    )
    return parsed.withColumn("parsed", F.when(matched, found).otherwise("")).withColumn(
        "problem", problem
    ).drop("_cells")


def elapsed(df: DataFrame, origin_source: str, origin: Column) -> DataFrame:
    """Signed microseconds from an origin time, for entries of the origin's own source."""
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(origin.cast("timestamp"))
    gap = F.when(F.col("source") == origin_source, gap)
    return df.withColumns({"elapsed_us": gap, "elapsed": elapsed_text(gap)})


def elapsed_text(gap: Column) -> Column:
    """``+0ms``, ``-28.812s``, ``+1m56.531s``; ``-`` for an entry without a time."""
    ms = F.floor(F.abs(gap) / 1000).cast("long")
    sign = F.when(gap < 0, "-").otherwise("+")
    minutes, rest = F.floor(ms / 60000).cast("long"), ms % 60000
    seconds = F.format_string("%d.%03ds", F.floor(rest / 1000).cast("long"), rest % 1000)
    padded = F.format_string("%02d.%03ds", F.floor(rest / 1000).cast("long"), rest % 1000)
    hours = F.floor(minutes / 60).cast("long")
    text = (
        F.when(ms < 1000, F.concat(sign, ms.cast("string"), F.lit("ms")))
        .when(minutes < 1, F.concat(sign, seconds))
        .when(hours < 1, F.concat(sign, minutes.cast("string"), F.lit("m"), padded))
        .otherwise(F.concat(sign, hours.cast("string"), F.lit("h"), F.format_string("%02d", minutes % 60), F.lit("m"), padded))
    )
    return F.coalesce(text, F.lit("-"))
