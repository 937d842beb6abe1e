"""Scans, folding, extraction and detection over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brackenlog.catalog import query
from brackenlog.catalog.logs import (
    DOC_LINES_SQL, document_lines, event_lines, event_log, log_sql, rendered, text, user_logs, user_logs_sql,
)
from brackenlog.logs import open_lines, open_logs
from brackenlog.operators.detect import coverage, detect_schemas, detect_set, detect_single, heal
from brackenlog.operators.extract import Lookup, check_samples, elapsed, parse
from brackenlog.operators.fold import fold_entries
from brackenlog.plans.builtin import ALL_SCHEMAS, BRACKETED, GENERIC
from brackenlog.plans.schema import LogSchema
from brackenlog.session import fresh_dir
from brackenlog.sources.files import head_sample, list_files, write_parsed, write_raw

f = Lookup(BRACKETED)
LOG = "WITH " + log_sql()
DOCS = "WITH " + DOC_LINES_SQL
USERS = "WITH " + user_logs_sql()
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


@query(LOG + f""" SELECT event_id AS entry_index, {TS} AS "timestamp", concat('h', user_id % 7) AS host,
  'S' AS server, (user_id % 11)::VARCHAR AS process_id, user_id::VARCHAR AS thread_id,
  concat('M', user_id % 5) AS log_module, level AS log_level, code AS error_code, user_id::VARCHAR AS user_id,
  (event_id % 13)::VARCHAR AS session_id, (event_id % 17)::VARCHAR AS object_id, 'F.cpp' AS file_name,
  event_id::VARCHAR AS line_number, message FROM log""")
def extract_fields(spark, sf_dir) -> DataFrame:
    return parse(event_log(spark, sf_dir), BRACKETED, time=False).select("entry_index", "fields.*")


@query(LOG + " SELECT event_id AS entry_index, code AS error_code FROM log WHERE code <> ''")
def optional_code(spark, sf_dir):
    df = parse(event_log(spark, sf_dir), BRACKETED, wanted=["error_code", "log_level"], time=False)
    return df.select("entry_index", f("error_code").alias("error_code")).filter("error_code <> ''")


@query(LOG + """ SELECT event_id AS entry_index, level, concat('M', user_id % 5) AS module, (user_id % 11)::VARCHAR AS pid,
  user_id::VARCHAR AS thread, 'F.cpp' AS file, event_id::VARCHAR AS line, '' AS origin, '' AS unknown FROM log""")
def field_alias(spark, sf_dir):
    names = ["level", "module", "pid", "thread", "file", "line"]
    df = parse(event_log(spark, sf_dir), BRACKETED, time=False)
    return df.select(
        "entry_index", *[f(n).alias(n) for n in names], f("source").alias("origin"), f("nosuch").alias("unknown")
    )


@query(f"SELECT event_id AS entry_index, {TS} AS ts FROM events")
def event_time(spark, sf_dir):
    df = parse(event_log(spark, sf_dir), BRACKETED, wanted=["timestamp"])
    return df.select("entry_index", text(F.col("ts")).alias("ts"))


@query(f"""SELECT event_id AS entry_index, CASE event_id % 4 WHEN 3 THEN NULL
  ELSE {TS} END AS ts FROM events""")
def sniff_time(spark, sf_dir):
    raw = """CASE event_id % 4 WHEN 0 THEN concat('[', replace(stamp, '-', '/'), '] up')
      WHEN 1 THEN concat(' ', replace(replace(stamp, ' ', 'T'), '.', ','), 'Z up') WHEN 2 THEN concat(stamp, '000') ELSE concat('at ', stamp) END"""
    df = rendered(spark, sf_dir).select(F.col("event_id").alias("entry_index"), F.expr(raw).alias("raw"))
    return parse(df, GENERIC).select("entry_index", text(F.col("ts")).alias("ts"))


_GAP = "epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events WHERE event_type = 'purchase')"


@query(f"""WITH g AS (SELECT event_id AS entry_index, {_GAP} AS gap FROM events),
  h AS (SELECT *, abs(gap) // 1000 AS ms FROM g)
  SELECT entry_index, gap AS elapsed_us, concat(CASE WHEN gap < 0 THEN '-' ELSE '+' END,
    CASE WHEN ms < 1000 THEN concat(ms, 'ms')
      WHEN ms < 60000 THEN printf('%d.%03ds', ms // 1000, ms % 1000)
      WHEN ms < 3600000 THEN printf('%dm%02d.%03ds', ms // 60000, ms % 60000 // 1000, ms % 1000)
      ELSE printf('%dh%02dm%02d.%03ds', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) END) AS elapsed FROM h""")
def elapsed_time(spark, sf_dir):
    df = parse(event_log(spark, sf_dir), BRACKETED, wanted=["timestamp", "log_level"])
    origin = df.filter(f("level") == "Warn").select(F.min("ts")).scalar()
    return elapsed(df, "app.log", origin).select("entry_index", "elapsed_us", "elapsed")


# ---- folding ------------------------------------------------------------------------

STARTS = LogSchema("starts", "<first> <rest>", entry_start="^[A-M]")
BOUNDED = LogSchema("bounded", "<first> <rest>", entry_start="^[A-M]", entry_end=r"[ae]\.$")
EARLY = LogSchema("early", "<first> <rest>", entry_start="^[A-F]")
LATE = LogSchema("late", "<word>. <rest>", entry_start="^[S-Z]")


def fold_sql(start: str, end: str = "false") -> str:
    """Sequential folding with explicit boundaries, as running windows over whole sources."""
    before = "OVER (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{DOCS}, flags AS (SELECT *, {start} AS st, {end} AS en, NOT regexp_matches(value, '\\S') AS blank FROM doc_lines),
      left_behind AS (SELECT *, CASE WHEN NOT blank THEN NOT en WHEN en THEN false END AS leaves FROM flags),
      states AS (SELECT *, coalesce(last_value(leaves IGNORE NULLS) {before}, false) AS is_open FROM left_behind),
      begun AS (SELECT *, (NOT is_open AND NOT blank) OR (is_open AND st) AS begins FROM states),
      numbered AS (SELECT *, sum(begins::BIGINT) OVER (PARTITION BY source ORDER BY line_no) AS nth FROM begun),
      folded AS (SELECT source, (nth - 1)::BIGINT AS entry_index, min(line_no) AS line_no,
        string_agg(value, chr(10) ORDER BY line_no) AS raw FROM numbered WHERE is_open OR NOT blank GROUP BY source, nth)"""


def _entries(df: DataFrame) -> DataFrame:
    return df.select("source", "entry_index", "line_no", F.md5("raw").alias("raw_md5"))


@query(fold_sql("regexp_matches(value, '^[A-M]')") + " SELECT source, entry_index, line_no, md5(raw) AS raw_md5 FROM folded")
def fold_documents(spark, sf_dir):
    return _entries(fold_entries(document_lines(spark, sf_dir), STARTS))


@query(fold_sql("regexp_matches(value, '^[A-M]')", r"regexp_matches(value, '[ae]\.$')") + " SELECT source, entry_index, line_no, md5(raw) AS raw_md5 FROM folded")
def fold_boundaries(spark, sf_dir):
    return _entries(fold_entries(document_lines(spark, sf_dir), BOUNDED))


@query(DOCS + " SELECT source, line_no - 1 AS entry_index, line_no, md5(value) AS raw_md5 FROM doc_lines")
def fold_without_schema(spark, sf_dir):
    return _entries(fold_entries(document_lines(spark, sf_dir)))


@query(LOG + """, placed AS (SELECT concat(event_type, '.log') AS source, event_id, raw,
    length(raw) - length(replace(raw, chr(10), '')) + 1 AS n FROM log)
  SELECT source, (row_number() OVER w - 1)::BIGINT AS entry_index, (sum(n) OVER w - n + 1)::BIGINT AS line_no, md5(raw) AS raw_md5
  FROM placed WINDOW w AS (PARTITION BY source ORDER BY event_id)""")
def fold_events(spark, sf_dir):
    return _entries(fold_entries(event_lines(spark, sf_dir), BRACKETED))


@query(fold_sql("regexp_matches(value, '^[A-FS-Z]')") + """, heads AS (SELECT *, string_split(raw, chr(10))[1] AS head FROM folded),
  picked AS (SELECT *, CASE WHEN regexp_matches(head, '^[A-F]') AND contains(raw, ' ') THEN 'early'
    WHEN regexp_matches(head, '^[S-Z]') AND contains(raw, '. ') THEN 'late'
    WHEN contains(raw, ' ') THEN 'early' WHEN contains(raw, '. ') THEN 'late' ELSE 'early' END AS schema_name FROM heads)
  SELECT source, entry_index, schema_name, CASE WHEN schema_name = 'early' AND contains(head, ' ')
    THEN string_split(head, ' ')[1] ELSE '' END AS first,
    md5(CASE WHEN schema_name = 'early' AND contains(head, ' ') THEN substr(raw, strpos(raw, ' ') + 1)
         WHEN schema_name = 'late' AND contains(head, '. ') THEN substr(raw, strpos(raw, '. ') + 2) ELSE raw END) AS rest_md5 FROM picked""")
def fold_schema_set(spark, sf_dir):
    schemas = [EARLY, LATE]
    entries = fold_entries(document_lines(spark, sf_dir), schemas)
    get = Lookup(schemas)
    return parse(entries, schemas, time=False).select(
        "source", "entry_index", "schema_name", get("first").alias("first"), F.md5(get("rest")).alias("rest_md5")
    )


@query(DOCS + " SELECT source, line_no, md5(value) AS value_md5 FROM doc_lines WHERE line_no <= 200")
def head_lines(spark, sf_dir):
    sample = head_sample(document_lines(spark, sf_dir).drop("line_no"))
    return sample.select("source", "line_no", F.md5("value").alias("value_md5"))


# ---- files --------------------------------------------------------------------------


@query(LOG + """ SELECT level, concat('M', user_id % 5) AS module, count(*) AS entries,
  sum(length(raw) - length(replace(raw, chr(10), '')) + 1)::BIGINT AS lines FROM log GROUP BY ALL""")
def open_files(spark, sf_dir):
    """Entries written as text files and opened again without naming their schema."""
    folder = fresh_dir(spark, "logs")
    write_raw(event_log(spark, sf_dir), folder)
    files = [p for p in list_files(spark, folder) if p.rsplit("/", 1)[-1].startswith("part-")]
    lines = F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit(""))) + 1
    return open_logs(spark, files).groupBy(f("level").alias("level"), f("module").alias("module")).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(lines).alias("lines")
    )


@query("""SELECT strftime(ts, '%Y-%m-%d') AS "date", count(*) AS entries FROM events WHERE event_type = 'error' GROUP BY 1""")
def parsed_sink(spark, sf_dir):
    """Parsed entries stored by day and level; one level read back with partition pruning."""
    folder = fresh_dir(spark, "parsed")
    df = parse(event_log(spark, sf_dir), BRACKETED)
    write_parsed(df.select("entry_index", "ts", f("module").alias("module"), f("level").alias("level")), folder)
    stored = spark.read.parquet(folder).filter(F.col("level") == "Error")
    return stored.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("entries"))


# ---- detection ----------------------------------------------------------------------

# Heads decide: a continuation line matches no schema but counts as a line.
_KINDS = """, sample AS (SELECT *, br AND nth = 1 AS b_head, lj AND nth = 1 AS l_head FROM user_lines WHERE line_no <= 200),
  kinds AS (SELECT source, count(*) AS n, count(*) FILTER (b_head) AS b, count(*) FILTER (l_head) AS l FROM sample GROUP BY source)"""
_SET = """concat_ws(',', CASE WHEN b * 5 >= n THEN 'Bracketed default' END, CASE WHEN l * 5 >= n THEN 'Log4j2 Default' END)"""
_SINGLE = "CASE WHEN b > 0 THEN 'Bracketed default' WHEN l > 0 THEN 'Log4j2 Default' ELSE 'Generic line' END"


@query(USERS + _KINDS + f" SELECT source, {_SET} AS schemas FROM kinds WHERE b + l > 0", name="detect_set")
def detect_sets(spark, sf_dir):
    found = detect_set(head_sample(user_logs(spark, sf_dir)), ALL_SCHEMAS)
    return found.select("source", F.array_join("schemas", ",").alias("schemas"))


@query(USERS + _KINDS + f" SELECT source, {_SINGLE} AS schema_name FROM kinds", name="detect_single")
def detect_one(spark, sf_dir):
    return detect_single(head_sample(user_logs(spark, sf_dir)), ALL_SCHEMAS)


@query(USERS + _KINDS + f" SELECT source, CASE WHEN b + l > 0 THEN {_SET} ELSE 'Generic line' END AS schemas FROM kinds", name="detect_schema")
def detect_choice(spark, sf_dir):
    found = detect_schemas(head_sample(user_logs(spark, sf_dir)), ALL_SCHEMAS)
    return found.select("source", F.array_join("schemas", ",").alias("schemas"))


@query(USERS + _KINDS + """ SELECT source, 'Bracketed default' AS schema_name, b AS matched, b + (NOT first_br)::BIGINT AS total
  FROM kinds JOIN (SELECT source, b_head AS first_br FROM sample WHERE line_no = 1) USING (source)
  UNION ALL SELECT source, 'Generic line', n, n FROM kinds""")
def schema_coverage(spark, sf_dir):
    return coverage(head_sample(user_logs(spark, sf_dir)), [BRACKETED, GENERIC]).drop("_rank")


@query(USERS + _KINDS + f" SELECT source, CASE WHEN l > 0 THEN 'Log4j2 Default' ELSE {_SINGLE} END AS schema_name FROM kinds")
def heal_schemas(spark, sf_dir):
    lines = user_logs(spark, sf_dir)
    assigned = lines.select("source", F.lit("Log4j2 Default").alias("schema_name")).distinct()
    return heal(assigned, head_sample(lines), ALL_SCHEMAS)


# Entries begin at the heads of the source's formats, and at its first line whatever that is.
@query(USERS + _KINDS + f""", sets AS (SELECT source, b * 5 >= n AS has_b, l * 5 >= n AS has_l FROM kinds),
  seen AS (SELECT *, user_id % 4 = 2 AS pr FROM user_lines JOIN sets USING (source)),
  named AS (SELECT CASE WHEN br AND nth = 1 AND has_b THEN 'Bracketed default' WHEN lj AND nth = 1 AND has_l THEN 'Log4j2 Default' WHEN pr THEN 'Generic line'
    WHEN line_no = 1 THEN CASE WHEN has_b THEN 'Bracketed default' ELSE 'Log4j2 Default' END END AS schema_name FROM seen)
  SELECT schema_name, count(*) AS entries FROM named WHERE schema_name IS NOT NULL GROUP BY 1""")
def mixed_sources(spark, sf_dir):
    """Logs of many users, each opened under the schemas its own head calls for."""
    folder = fresh_dir(spark, "lines")
    user_logs(spark, sf_dir).write.parquet(folder)  # detection and folding both read the lines
    df = open_lines(spark.read.parquet(folder))
    return df.groupBy("schema_name").agg(F.count(F.lit(1)).alias("entries"))


@query(LOG + """ SELECT event_id AS entry_index, concat(level, '][', code) AS parsed, 'wrong level' AS problem FROM log WHERE code <> ''""")
def sample_check(spark, sf_dir):
    """Labelled lines against a schema that matches them but reads coded levels wrongly."""
    old = LogSchema("no code", BRACKETED.template.replace("[<error_code?>]", ""))
    lines = rendered(spark, sf_dir).select(F.col("event_id").alias("entry_index"), "raw", F.col("level").alias("expected"))
    found = check_samples(lines, old).filter("problem IS NOT NULL")
    return found.select("entry_index", "parsed", "problem")
