"""Rules and searches over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackenlog.catalog import query
from brackenlog.catalog.entries import DOCS, LOG, f
from brackenlog.catalog.logs import document_lines, event_log, numbered_lines, spread, table, user_entries, user_logs_sql
from brackenlog.operators.extract import Lookup, parse
from brackenlog.operators.rule_tables import apply_table, table_hits
from brackenlog.operators.stats import count_matches, pattern_hits, preview_rows, rule_hits, rule_preview, with_rule_hits
from brackenlog.plans.builtin import BRACKETED, GENERIC, LOG4J2, SAVED_SEARCHES
from brackenlog.plans.rules import Rule, add, apply_rules, distinct_rules, hide_like, like_row, newest_time_range, visible
from brackenlog.plans.search import compile_search, last_range, mark, search, tag

IDS = " SELECT event_id AS entry_index FROM log WHERE "
plain = Lookup(GENERIC)


def parsed(spark, sf_dir, time=False, **kw):
    return parse(event_log(spark, sf_dir), BRACKETED, time=time, **kw)


def kept(spark, sf_dir, *rules, time=False):
    return apply_rules(parsed(spark, sf_dir, time), list(rules), f).select("entry_index")


@query(LOG + """ SELECT concat('M', user_id % 5) AS module, count(*) AS errors FROM log WHERE level = 'Error' GROUP BY 1""")
def errors_per_module(spark, sf_dir):
    rules = [Rule("level", "equals", "Trace", "exclude"), Rule("level", "equals", "Error", "include")]
    shown = apply_rules(parsed(spark, sf_dir, wanted=["log_level", "log_module"]), rules, f)
    return shown.groupBy(f("module").alias("module")).agg(F.count(F.lit(1)).alias("errors"))


@query(LOG + " SELECT event_id AS entry_index, raw FROM log WHERE level = 'Error'")
def filter_equals(spark, sf_dir):
    shown = apply_rules(parsed(spark, sf_dir), [Rule("level", "equals", "Error", "include")], f)
    return shown.select("entry_index", "raw")


@query(LOG + IDS + "contains(lower(message), 'page v') OR contains(lower(message), 'clicked')")
def filter_contains(spark, sf_dir):
    return kept(spark, sf_dir, Rule("message", "contains", "PAGE v", "include"), Rule("message", "contains", "CliCked", "include"))


@query(LOG + IDS + r"NOT regexp_matches(message, 'after \d{2,}ms|total=\d+\.\d+|node')")
def filter_regex(spark, sf_dir):
    return kept(spark, sf_dir, Rule("message", "regex", r"after \d{2,}ms|total=\d+\.\d+|node", "exclude"))


@query(LOG + IDS + "ts >= TIMESTAMP '2024-01-03 12:00:00' AND ts <= TIMESTAMP '2024-01-20'")
def filter_range_time(spark, sf_dir):
    return kept(spark, sf_dir, Rule("timestamp", "range", "2024-01-03T12:00 .. 2024-01-20", "include"), time=True)


@query(LOG + IDS + "user_id::VARCHAR >= '12' AND user_id::VARCHAR <= '45'")
def filter_range_text(spark, sf_dir):
    return kept(spark, sf_dir, Rule("thread", "range", "12..45", "include"))


@query(LOG + IDS + """(contains(lower(concat('M', user_id % 5)), 'm3') OR regexp_matches(message, '^Order \\d+ '))
  AND NOT (level = 'Trace' OR user_id % 7 = 2)""")
def filter_include_exclude(spark, sf_dir):
    return kept(
        spark, sf_dir,
        Rule("module", "contains", "m3", "include"), Rule("message", "regex", r"^Order \d+ ", "include"),
        Rule("level", "equals", "Trace", "exclude"), Rule("host", "equals", "h2", "exclude"),
        Rule("level", "equals", "Error", "exclude", enabled=False), Rule("message", "regex", "(broken", "exclude"),
    )


@query(f"""WITH {user_logs_sql()}
  SELECT source, line_no, event_id, md5(value) AS value_md5 FROM user_lines
  WHERE CASE WHEN lj THEN level <> 'Trace' WHEN br THEN level = 'Error' ELSE level = 'none' END""")
def filter_scoped(spark, sf_dir):
    """One rule per schema: includes of a schema leave entries of the others alone.

    Every physical line of the entries that are shown, with its number in the whole log.
    """
    schemas = [BRACKETED, LOG4J2]
    df = user_entries(spark, sf_dir)
    df = parse(df, schemas, time=False)
    rules = [
        Rule("level", "equals", "Error", "include", log_schema="Bracketed default"),
        Rule("level", "equals", "TRACE", "exclude", log_schema="Log4j2 Default"),
    ]
    judged = df.select("source", "event_id", "raw", visible(rules, Lookup(schemas)).alias("shown"))
    return numbered_lines(judged).filter("shown").select("source", "line_no", "event_id", F.md5("value").alias("value_md5"))


@query(LOG + IDS + "level <> 'Trace' AND ts <= TIMESTAMP '2024-01-10'")
def filter_time_slot(spark, sf_dir):
    """A second time range replaces the first."""
    rules = add([], Rule("timestamp", "range", "2024-01-20..", "include"))
    rules = add(rules, Rule("level", "equals", "Trace", "exclude"))
    rules = add(rules, Rule("ts", "range", "..2024-01-10", "include"))
    return kept(spark, sf_dir, *rules, time=True)


@query(LOG + IDS + "user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 11 = 3)")
def hide_by_example(spark, sf_dir):
    df = parsed(spark, sf_dir)
    examples = df.filter((f("level") == "Error") & (f("pid") == "3")).select(f("thread").alias("thread"))
    return hide_like(df, examples, f("thread")).select("entry_index")


@query(LOG + IDS + "user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 11 = 3)")
def keep_by_example(spark, sf_dir):
    df = parsed(spark, sf_dir)
    examples = df.filter((f("level") == "Error") & (f("pid") == "3")).select(f("thread").alias("thread"))
    return hide_like(df, examples, f("thread"), keep=True).select("entry_index")


@query(LOG + IDS + "concat('M', user_id % 5) <> (SELECT concat('M', user_id % 5) FROM events WHERE event_id = 0)")
def hide_like_row(spark, sf_dir):
    df = parsed(spark, sf_dir)
    row = df.select("entry_index", f("module").alias("module")).orderBy("entry_index").first()
    return apply_rules(df, [like_row(row, "module")], f).select("entry_index")


@query(LOG + IDS + "user_id % 7 = 1 AND level = 'Error' AND code = ''")
def pinned_fields(spark, sf_dir):
    df = event_log(spark, sf_dir)
    chosen = {"host": "h1", "log_level": "Error", "error_code": ""}
    return df.filter(BRACKETED.pinned(F.col("raw"), chosen)).select("entry_index")


# ---- rules as data ------------------------------------------------------------------

AUDITED = [
    Rule("level", "equals", "Error", "include"),
    Rule("message", "contains", "USER", "include"),
    Rule("message", "regex", r"10\.0\.\d+\.7", "exclude"),
    Rule("thread", "range", "3..5", "exclude"),
]
_AUDIT = ["level = 'Error'", "contains(lower(message), 'user')", r"regexp_matches(message, '10\.0\.\d+\.7')",
          "user_id::VARCHAR >= '3' AND user_id::VARCHAR <= '5'"]


@query(LOG + " " + " UNION ALL ".join(
    f"SELECT {i}::INT AS position, '{r.action}' AS action, count(*) FILTER ({c}) AS hits FROM log"
    for i, (r, c) in enumerate(zip(AUDITED, _AUDIT))))
def rule_audit(spark, sf_dir):
    return rule_hits(parsed(spark, sf_dir), AUDITED, f)


@query(LOG + " SELECT event_id AS entry_index, concat_ws(',', " + ", ".join(
    f"CASE WHEN {c} THEN '{i}' END" for i, c in enumerate(_AUDIT)) + ") AS rules FROM log")
def rule_hits_per_entry(spark, sf_dir):
    df = with_rule_hits(parsed(spark, sf_dir), AUDITED, f)
    return df.select("entry_index", F.array_join(F.col("rule_positions").cast("array<string>"), ",").alias("rules"))


# A rule for every customer: on threads by value and by range, on times, and some on messages.
_MADE_RULES = {
    "position": "cast(c_custkey as int)",
    "field": "CASE WHEN c_custkey % 40 >= 37 THEN 'message' WHEN c_custkey % 4 = 3 THEN 'timestamp' ELSE 'thread' END",
    "op": "CASE WHEN c_custkey % 40 = 39 THEN 'regex' WHEN c_custkey % 40 >= 37 THEN 'contains' WHEN c_custkey % 4 < 2 THEN 'equals' ELSE 'range' END",
    "value": """CASE WHEN c_custkey % 40 = 39 THEN concat('k=[0-9]*', c_custkey % 10, ',')
      WHEN c_custkey % 40 >= 37 THEN concat('ID=', c_custkey % 700, ' ')
      WHEN c_custkey % 4 < 2 THEN cast(c_custkey % 400 as {string})
      WHEN c_custkey % 4 = 2 THEN concat(c_custkey % 90, '..', c_custkey % 90 + 3)
      WHEN c_custkey % 8 = 3 THEN concat('2024-01-', 10 + c_custkey % 5, ' .. 2024-01-', 12 + c_custkey % 5, ' 06:30')
      ELSE concat('2024-01-0', 1 + c_custkey % 9, ' .. 2024-01-0', 1 + c_custkey % 9, ' 06:30') END""",
    "action": "CASE WHEN c_custkey % 40 >= 37 THEN 'exclude' ELSE 'include' END",
}
_HELD = ["thread", "message"]
_RULE_HITS = ", made AS (SELECT " + ", ".join(f"{c} AS {n}" for n, c in _MADE_RULES.items()).format(string="VARCHAR") + """ FROM customer),
  bound AS (SELECT *, string_split(value, '..') AS b FROM made),
  rules AS (SELECT *, CASE WHEN field = 'timestamp' THEN strptime(trim(b[1]), '%Y-%m-%d') END AS lo,
    CASE WHEN field = 'timestamp' THEN strptime(trim(b[2]), '%Y-%m-%d %H:%M') END AS hi FROM bound),
  found AS (SELECT position, action, event_id FROM rules JOIN log ON CASE WHEN field = 'timestamp' THEN ts BETWEEN lo AND hi
    WHEN op = 'equals' THEN user_id::VARCHAR = rules.value WHEN op = 'range' THEN user_id::VARCHAR >= b[1] AND user_id::VARCHAR <= b[2]
    WHEN op = 'contains' THEN contains(lower(message), lower(rules.value)) ELSE regexp_matches(message, rules.value) END)"""


def made_rules(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select(*[F.expr(c.format(string="string")).alias(n) for n, c in _MADE_RULES.items()])
    missing = F.lit(None).cast("string")
    return made.withColumns({"log_schema": missing, "enabled": F.lit(True), "origin": missing})


@query(LOG + _RULE_HITS + " SELECT r.position, r.action, count(event_id) AS hits FROM rules r LEFT JOIN found USING (position) GROUP BY ALL")
def rule_table_audit(spark, sf_dir):
    """As many rules as customers, joined as data."""
    return table_hits(parsed(spark, sf_dir, time=True), made_rules(spark, sf_dir), f, _HELD)


@query(LOG + _RULE_HITS + IDS + """event_id IN (SELECT event_id FROM found WHERE action = 'include')
    AND event_id NOT IN (SELECT event_id FROM found WHERE action = 'exclude')""")
def rule_table_filter(spark, sf_dir):
    """The entries that as many rules leave."""
    return apply_table(parsed(spark, sf_dir, time=True), made_rules(spark, sf_dir), f, _HELD, "entry_index").select("entry_index")


@query(LOG + " SELECT count(*) FILTER (regexp_matches(message, 'id=\\d*7 ')) AS hits, count(*) AS shown FROM log WHERE level <> 'Trace'", name="rule_preview")
def preview(spark, sf_dir):
    shown = apply_rules(parsed(spark, sf_dir), [Rule("level", "equals", "Trace", "exclude")], f)
    return rule_preview(shown, Rule("message", "regex", r"id=\d*7 "), f)


@query(LOG + " SELECT event_id AS entry_index, raw FROM log WHERE regexp_matches(message, 'id=\\d*7 ') ORDER BY 1 LIMIT 5")
def preview_lines(spark, sf_dir):
    df = preview_rows(parsed(spark, sf_dir), Rule("message", "regex", r"id=\d*7 "), f, 5, "entry_index")
    return df.select("entry_index", "raw")


_RULE_ROWS = """SELECT event_id AS position, CASE WHEN user_id % 3 > 0 THEN 'Bracketed default' END AS log_schema,
  CASE WHEN event_type IN ('error', 'view') THEN 'timestamp' ELSE 'thread' END AS field,
  CASE WHEN event_type IN ('error', 'view') THEN 'range' ELSE 'equals' END AS op, props AS value,
  CASE WHEN event_type IN ('error', 'click') THEN 'include' ELSE 'exclude' END AS action,
  event_id % 2 = 0 AS enabled, event_type AS origin, user_id FROM events"""


def _rule_rows(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("brackenlog_events")
    return spark.sql(_RULE_ROWS.replace("FROM events", "FROM brackenlog_events"))


@query(f"""WITH r AS ({_RULE_ROWS}) SELECT min(position) AS position, log_schema, field, op, value, action, enabled,
  arg_min(origin, position) AS origin FROM r GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY log_schema, field, op, value, action, enabled"))
def rule_dedupe(spark, sf_dir):
    return distinct_rules(_rule_rows(spark, sf_dir).drop("user_id"))


@query(f"""WITH r AS ({_RULE_ROWS}), last AS (SELECT user_id, max(position) AS newest FROM r WHERE op = 'range' GROUP BY 1)
  SELECT r.user_id, position, field, value FROM r LEFT JOIN last ON r.user_id = last.user_id WHERE op <> 'range' OR position = newest""")
def newest_time_ranges(spark, sf_dir):
    kept_rules = newest_time_range(_rule_rows(spark, sf_dir), ["user_id"])
    return kept_rules.select("user_id", "position", "field", "value")


# ---- searches -----------------------------------------------------------------------


def found(spark, sf_dir, text, time=False):
    return search(parsed(spark, sf_dir, time), text, f)[0].select("entry_index")


@query("""SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations
  WHERE contains(lower(text), 'the') AND contains(lower(text), 'in the')""")
def search_text(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumnRenamed("text", "raw")
    return search(df, 'THE "in the"', plain)[0].select("conv_id", "turn", F.md5("raw").alias("text_md5"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(html, '(?i)<h[1-3][^>]*>[^<]*the') AND regexp_matches(html, '(?i)href=./(for|of|is)\\b')")
def search_regex(spark, sf_dir):
    df = table(spark, sf_dir, "pages").withColumnRenamed("html", "raw")
    return search(df, r'"/<H[1-3][^>]*>[^<]*THE/" "/href=./(for|of|is)\b/"', plain)[0].select("page_id", "url")


@query(LOG + IDS + "level = 'Warn' AND concat('M', user_id % 5) = 'M4'")
def search_field_eq(spark, sf_dir):
    return found(spark, sf_dir, "level=Warn module=M4")


@query(LOG + IDS + "contains(lower(message), 'order 1') AND contains(user_id::VARCHAR, '3')")
def search_field_contains(spark, sf_dir):
    return found(spark, sf_dir, '"message~ORDER 1" thread~3')


@query(LOG + IDS + "regexp_matches(message, '(?i)^page VIEW 0x[0-9a-f]*F ') AND regexp_matches(level, '(?i)^DE')")
def search_field_regex(spark, sf_dir):
    return found(spark, sf_dir, '"message=/^page VIEW 0x[0-9a-f]*F /" level=/^DE/')


@query(LOG + IDS + "ts >= TIMESTAMP '2024-01-05 06:30:00' AND ts <= TIMESTAMP '2024-01-09'")
def search_after_before(spark, sf_dir):
    return found(spark, sf_dir, "after:2024-01-05T06:30 before:2024/01/09", time=True)


@query(LOG + IDS + "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06 01:02:03.5' AND level <> 'x'")
def search_date_range(spark, sf_dir):
    return found(spark, sf_dir, "date:[2024-01-05..2024-01-06T01:02:03.5]", time=True)


@query("SELECT event_id AS entry_index FROM events WHERE event_type = 'error'")
def search_bad_terms(spark, sf_dir):
    """Terms that cannot be read are dropped; the others still apply."""
    return found(spark, sf_dir, "/(unclosed/ level=Error after:someday")


_TAGS = ", ".join(
    "CASE WHEN " + " AND ".join(f"regexp_matches(text, '(?i){term[1:-1]}')" for term in query_text.split(" ")) + f" THEN '{label}' END"
    for label, query_text in SAVED_SEARCHES.items())


@query(f"SELECT doc_id, concat_ws('|', {_TAGS}) AS tags FROM documents")
def search_saved(spark, sf_dir):
    df = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw")))
    return tag(df, SAVED_SEARCHES, plain).select("doc_id", F.array_join("tags", "|").alias("tags"))


@query(LOG + IDS + "contains(lower(raw), 'user') AND level = 'Error' AND contains(message, 'id=1')")
def search_refine(spark, sf_dir):
    first = search(parsed(spark, sf_dir), "user level=Error", f)[0]
    return search(first, "message~id=1", f)[0].select("entry_index")


@query(LOG + " SELECT event_id AS entry_index, contains(lower(raw), 'failed') AS is_match FROM log")
def search_mark(spark, sf_dir):
    return mark(event_log(spark, sf_dir), "FAILED", f).select("entry_index", "is_match")


@query("SELECT event_id AS entry_index FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS", name="last_range")
def last_day(spark, sf_dir):
    return last_range(parsed(spark, sf_dir, time=True, wanted=["timestamp"]), "24 hours").select("entry_index")


@query(LOG + " SELECT count(*) FILTER (level = 'Error' AND contains(lower(raw), 'after 9')) AS matches FROM log", name="count_matches")
def matches(spark, sf_dir):
    return count_matches(parsed(spark, sf_dir), 'level=Error "after 9"', f)


_LADDER = {"loose": r"Request.*failed.*user", "prefix": r"Request\s+id=.*", "typed": r"Request\s+id=\d+\s+failed\s+for\s+user\s+\d+\s+after\s+\d+ms", "other": "[[:upper:]][[:lower:]]+ user"}


@query(LOG + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) FILTER (regexp_matches(message, '{p}')) AS hits FROM log" for n, p in _LADDER.items()), name="pattern_hits")
def ladder_hits(spark, sf_dir):
    return pattern_hits(parsed(spark, sf_dir), f("message"), _LADDER)


@query(DOCS + """ SELECT source, count(*) AS lines FROM doc_lines WHERE contains(lower(value), 'the') GROUP BY 1""")
def matching_lines(spark, sf_dir):
    lines = document_lines(spark, sf_dir).withColumnRenamed("value", "raw")
    hit = compile_search("the", plain).condition
    return lines.filter(hit).groupBy("source").agg(F.count(F.lit(1)).alias("lines"))

