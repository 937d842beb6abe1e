"""Logs rendered from the given tables, in Spark and in SQL.

``event_log``: one bracketed entry per event; every third error has two continuation
lines. ``document_lines``: the physical lines of the documents. ``user_logs``: one log per
user, each in one of several formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brackenlog.operators.blocks import dense_position
from brackenlog.operators.fold import by_line_number, split_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the scan has fewer tasks than that, as for one small file.

    A large table is scanned by many tasks already and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


_LEVEL = """CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warn'
  WHEN 'signup' THEN 'Info' WHEN 'view' THEN 'Debug' ELSE 'Trace' END"""
_K = "regexp_extract(props, '([0-9]+)', 1)"
_HEAD = """CASE event_type
  WHEN 'error' THEN concat('Request id=', event_id, ' failed for user ', user_id, ' after ', {k}, 'ms')
  WHEN 'purchase' THEN concat('Order ', event_id, ' total=', {k}, '.', event_id % 100, ' placed by user ', user_id)
  WHEN 'signup' THEN concat('Accepted user ', user_id, ' from 10.0.', user_id % 256, '.', {k}, ';')
  WHEN 'view' THEN concat('Page view 0x', {hex}, ' by ''user', user_id, '''')
  ELSE concat('Clicked item k=', {k}, ', node ', {node}) END"""
_TRACE = """CASE WHEN event_type = 'error' AND event_id % 3 = 0
  THEN concat({nl}, '    at Frame::run() (core.cpp:', {k}, ')', {nl}, '    at main() (main.cpp:7)') ELSE '' END"""
_CODE = "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN concat('0x8004', {hex4}) ELSE '' END"
_RAW = """concat({ts}, ' [HOST:h', user_id % 7, '][SERVER:S][PID:', user_id % 11, '][THR:', user_id, '][M',
  user_id % 5, '][', level, ']', CASE WHEN code = '' THEN '' ELSE concat('[', code, ']') END, '[UID:', user_id,
  '][SID:', event_id % 13, '][OID:', event_id % 17, '][F.cpp:', event_id, '] ', message)"""

_SPARK = {"k": _K, "hex": "hex(event_id)", "node": "lpad(hex(event_id + 1048576), 8, '0')",
          "hex4": "lpad(hex(event_id % 65536), 4, '0')", "nl": r"'\n'", "ts": "stamp"}
_DUCK = {"k": _K, "hex": "printf('%X', event_id)", "node": "printf('%08X', event_id + 1048576)",
         "hex4": "printf('%04X', event_id % 65536)", "nl": "chr(10)",
         "ts": "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"}


def _parts(words: dict) -> tuple[str, str, str]:
    message = f"concat({_HEAD.format(**words)}, {_TRACE.format(**words)})"
    return _LEVEL, _CODE.format(**words), message


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their log entry in ``raw``."""
    level, code, message = _parts(_SPARK)
    return (
        spread(table(spark, sf_dir, "events"))
        .withColumn("stamp", text(F.col("ts")))
        .withColumn("level", F.expr(level))
        .withColumn("code", F.expr(code))
        .withColumn("message", F.expr(message))
        .withColumn("raw", F.expr(_RAW.format(**_SPARK)))
    )


def event_log(spark: SparkSession, sf_dir: str, per_type: bool = False) -> DataFrame:
    """Entries ``source, entry_index, raw``: one source, or one per event type."""
    source = F.concat(F.col("event_type"), F.lit(".log")) if per_type else F.lit("app.log")
    return rendered(spark, sf_dir).select(source.alias("source"), F.col("event_id").alias("entry_index"), "raw")


def event_lines(spark: SparkSession, sf_dir: str, block: int = 1 << 18) -> DataFrame:
    """Physical lines of the event log, one source per event type."""
    lines = rendered(spark, sf_dir).select(
        F.concat(F.col("event_type"), F.lit(".log")).alias("source"),
        "event_id",
        F.posexplode(F.split("raw", "\n")).alias("at", "value"),
    )
    return lines.select(
        "source",
        F.floor(F.col("event_id") / F.lit(block)).alias("split"),
        F.struct("event_id", "at").alias("pos"),
        "value",
    )


LOG_SQL = """log AS (
  SELECT *, {raw} AS raw FROM (
    SELECT *, {level} AS level, {code} AS code, {message} AS message FROM events)
)"""


def log_sql() -> str:
    """The event log as a SQL common table expression ``log``."""
    level, code, message = _parts(_DUCK)
    return LOG_SQL.format(raw=_RAW.format(**_DUCK), level=level, code=code, message=message)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return by_line_number(split_text(docs, "text", F.concat(F.lit("doc-"), F.col("doc_id"))))


DOC_LINES_SQL = """doc_lines AS (
  SELECT source, line_no, rtrim(value, chr(13) || chr(10)) AS value FROM (
    SELECT concat('doc-', doc_id) AS source, unnest(parts) AS value,
           generate_subscripts(parts, 1)::BIGINT AS line_no
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""

# Users of kind 0 log in the bracketed format, 1 like Log4j2, 2 in prose, 3 in both formats.
_LOG4J = """concat({sec}, ',', lpad(cast(event_id % 1000 as {string}), 3, '0'), ' [main] ',
  upper(level), ' com.example.M', user_id % 5, ' - ', message)"""
_LINE = """CASE WHEN user_id % 4 = 0 OR (user_id % 4 = 3 AND event_id % 2 = 0) THEN raw
  WHEN user_id % 4 = 2 THEN concat('note by ', user_id, ' that ', message)
  ELSE {log4j} END"""


def user_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole entries ``source, event_id, raw``, one source per user."""
    log4j = _LOG4J.format(sec="substring(stamp, 1, 19)", string="string")
    return rendered(spark, sf_dir).select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("source"),
        "event_id",
        F.expr(_LINE.format(log4j=log4j)).alias("raw"),
    )


def user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered physical lines ``source, line_no, value`` of the entries of every user."""
    return numbered_lines(user_entries(spark, sf_dir)).select("source", "line_no", "value")


def numbered_lines(entries: DataFrame) -> DataFrame:
    """Physical lines of entries ``source, event_id, raw``, numbered within their source; other columns stay."""
    df = entries.select(*[c for c in entries.columns if c != "raw"], F.posexplode(F.split("raw", "\n")).alias("at", "value"))
    # No entry of these logs has 2**10 lines, so this orders the lines of a source.
    numbered = dense_position(df.withColumn("_order", F.col("event_id") * 1024 + F.col("at")), "_order", block=1 << 28)
    return numbered.withColumn("line_no", F.col("position") + 1).drop("position", "_order", "at")


def user_logs_sql() -> str:
    log4j = _LOG4J.format(sec="strftime(ts, '%Y-%m-%d %H:%M:%S')", string="varchar")
    line = _LINE.format(log4j=log4j)
    return f"""{log_sql()},
user_entries AS (SELECT concat('user-', user_id) AS source, user_id, event_id, level, {line} AS value,
    user_id % 4 = 0 OR (user_id % 4 = 3 AND event_id % 2 = 0) AS br,
    user_id % 4 = 1 OR (user_id % 4 = 3 AND event_id % 2 = 1) AS lj FROM log),
user_parts AS (SELECT * EXCLUDE value, unnest(string_split(value, chr(10))) AS value,
    generate_subscripts(string_split(value, chr(10)), 1) AS nth FROM user_entries),
user_lines AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id, nth) AS line_no FROM user_parts)"""
