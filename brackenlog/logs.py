"""Logs to parsed entries in one call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from brackenlog.operators.detect import detect_schemas, schema_sets
from brackenlog.operators.extract import parse, with_fields
from brackenlog.operators.fold import by_line_number, fold_entries
from brackenlog.plans.builtin import ALL_SCHEMAS, BRACKETED
from brackenlog.plans.schema import LogSchema
from brackenlog.session import stored
from brackenlog.sources.files import head_sample, read_heads, read_lines


def open_logs(
    spark: SparkSession, paths: Sequence[str], candidates: Sequence[LogSchema] = ALL_SCHEMAS
) -> DataFrame:
    """Detect the schemas of every file, fold its lines and parse its entries.

    The paths are known to the driver already; so is then the schema set of each, and files
    of one set are scanned together without joining the set onto every line. The lines are
    stored before they are folded: where Spark cuts a file follows the cores it has at the
    time, so a second scan may cut otherwise, and a live file may have grown. ``fields`` hold
    every field of the candidates, null where an entry has none of that name. Without paths,
    or with empty files only, there are no entries, in the same columns.
    """
    by_name = {s.name: s for s in [BRACKETED, *candidates]}
    groups: dict[tuple[str, ...], list[str]] = {}
    if paths:
        detected = detect_schemas(read_heads(spark, list(dict.fromkeys(paths))), candidates)
        for row in detected.collect():
            groups.setdefault(tuple(row.schemas), []).append(row.source)
    if not groups:
        return open_lines(spark.createDataFrame([], "source string, line_no long, value string"), candidates)
    frames = []
    for names, files in sorted(groups.items()):
        schemas = [by_name[n] for n in names]
        lines = stored(read_lines(spark, sorted(files)), "lines")
        parsed = parse(fold_entries(lines, schemas), schemas)
        frames.append(with_fields(parsed, list(by_name.values())))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def open_lines(lines: DataFrame, candidates: Sequence[LogSchema] = ALL_SCHEMAS) -> DataFrame:
    """``open_logs`` for lines that come from a table."""
    known = list({s.name: s for s in [*candidates, BRACKETED]}.values())
    assigned, sets = schema_sets(detect_schemas(head_sample(lines), candidates), known)
    sets = sets or [[0]]
    # Columns are built for the schemas that occur, not for the whole library.
    used = sorted({i for order in sets for i in order})
    known = [known[i] for i in used]
    sets = [[used.index(i) for i in order] for order in sets]
    if "split" not in lines.columns:
        lines = by_line_number(lines)
    entries = fold_entries(lines.join(assigned, "source"), known, sets)
    return with_fields(parse(entries, known, sets), [*candidates, BRACKETED])
