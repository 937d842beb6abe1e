"""Views, counts and joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackenlog.catalog import query
from brackenlog.catalog.entries import LOG, STARTS, TS, f, fold_sql
from brackenlog.catalog.filters import parsed
from brackenlog.catalog.logs import document_lines, event_log, table, text
from brackenlog.operators import stats
from brackenlog.operators.blocks import dense_position
from brackenlog.operators.extract import parse
from brackenlog.operators.fold import fold_entries
from brackenlog.operators.lookups import prune_bookmarks, with_bookmarks, with_source_info
from brackenlog.operators.views import context_rows, first_rows, match_ordinals, merge_sources, merge_times, union_sources
from brackenlog.plans.builtin import BRACKETED, GENERIC
from brackenlog.plans.search import mark
from brackenlog.sources.packs import first_by_name

TYPES = ("click", "error", "purchase", "signup", "view")


def timed_sources(spark, sf_dir):
    """One source per event type; every fifth entry has no time, signups have none at all."""
    df = parse(event_log(spark, sf_dir, per_type=True), BRACKETED, wanted=["timestamp"])
    ordinal = F.array_position(F.array(*[F.lit(f"{t}.log") for t in TYPES]), F.col("source")).cast("int")
    timeless = (F.col("entry_index") % 5 == 2) | (F.col("source") == "signup.log")
    return df.select("source", ordinal.alias("source_ord"), "entry_index", F.when(~timeless, F.col("ts")).alias("ts"))


_FILLED = """WITH timed AS (SELECT concat(event_type, '.log') AS source, event_id AS entry_index,
    CASE WHEN event_id % 5 <> 2 AND event_type <> 'signup' THEN ts END AS ts FROM events),
  filled AS (SELECT source, entry_index, coalesce(
      last_value(ts IGNORE NULLS) OVER (PARTITION BY source ORDER BY entry_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(ts IGNORE NULLS) OVER (PARTITION BY source ORDER BY entry_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ts
    FROM timed)"""


@query(_FILLED + f" SELECT source, entry_index, {TS} AS merge_time FROM filled")
def forward_fill(spark, sf_dir):
    return merge_times(timed_sources(spark, sf_dir)).select("source", "entry_index", text(F.col("merge_time")).alias("merge_time"))


@query(_FILLED + """ SELECT source, entry_index,
  row_number() OVER (ORDER BY ts NULLS FIRST, source, entry_index) - 1 AS position FROM filled""", name="merge_sources")
def merged(spark, sf_dir):
    return merge_sources(timed_sources(spark, sf_dir)).select("source", "entry_index", "position")


@query("""SELECT concat(event_type, '.log') AS source, event_id AS entry_index,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS position FROM events""", name="dense_position")
def positions(spark, sf_dir):
    return dense_position(event_log(spark, sf_dir, per_type=True), "entry_index").select("source", "entry_index", "position")


_SEQ = """, seq AS (SELECT event_id, level = 'Error' AND contains(message, 'after 9') AS hit,
    {partition} AS source FROM log WHERE level <> 'Trace'),
  near AS (SELECT *, bool_or(hit) OVER (PARTITION BY source ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS close FROM seq)
  SELECT source, event_id AS entry_index, hit AS is_match FROM near WHERE close"""


def _context(spark, sf_dir, per_type):
    df = parse(event_log(spark, sf_dir, per_type), BRACKETED, time=False).filter(f("level") != "Trace")
    marked = mark(df, 'level=Error "message~after 9"', f)
    return context_rows(marked, "is_match", 3).select("source", "entry_index", "is_match")


@query(LOG + _SEQ.format(partition="'app.log'"), name="context_rows")
def context(spark, sf_dir):
    return _context(spark, sf_dir, per_type=False)


@query(LOG + _SEQ.format(partition="concat(event_type, '.log')"))
def context_rows_per_source(spark, sf_dir):
    return _context(spark, sf_dir, per_type=True)


@query(LOG + """ SELECT 'app.log' AS source, event_id AS entry_index, row_number() OVER (ORDER BY event_id) AS ordinal,
  count(*) OVER () AS total FROM log WHERE contains(lower(raw), 'failed')""")
def match_ordinal(spark, sf_dir):
    found = mark(event_log(spark, sf_dir), "failed", f).filter("is_match")
    return match_ordinals(found).select("source", "entry_index", "ordinal", "total")


@query(LOG + " SELECT event_id AS entry_index, raw FROM log WHERE level <> 'Trace' ORDER BY 1 LIMIT 50", name="first_rows")
def first(spark, sf_dir):
    df = parsed(spark, sf_dir).filter(f("level") != "Trace")
    return first_rows(df, 50, "entry_index").select("entry_index", "raw")


@query(LOG + " SELECT event_id AS entry_index, raw FROM log WHERE level <> 'Trace' ORDER BY 1 LIMIT 500", name="first_rows_500")
def more_first(spark, sf_dir):
    df = parsed(spark, sf_dir).filter(f("level") != "Trace")
    return first_rows(df, 500, "entry_index").select("entry_index", "raw")


@query("SELECT source, count(*) AS entries FROM (SELECT 'events' AS source FROM events UNION ALL SELECT 'chats' FROM conversations) GROUP BY 1", name="union_sources")
def union(spark, sf_dir):
    """Sources with different fields stacked; a field one of them lacks is empty."""
    events = parsed(spark, sf_dir).withColumn("source", F.lit("events"))
    chats = table(spark, sf_dir, "conversations").select(F.lit("chats").alias("source"), F.col("text").alias("raw"))
    both = union_sources([events, parse(chats, GENERIC, time=False)])
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("entries"))


# ---- counts -------------------------------------------------------------------------


@query(LOG + " SELECT level, count(*) AS entries FROM log GROUP BY 1", name="level_breakdown")
def levels(spark, sf_dir):
    return stats.level_breakdown(parsed(spark, sf_dir, wanted=["log_level"]), f)


@query(LOG + """, span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
  SELECT least(floor((epoch_us(ts) - lo)::DOUBLE / (hi - lo)::DOUBLE * 48), 47)::INT AS bucket, level AS key, count(*) AS entries
  FROM log, span GROUP BY ALL""", name="timeline")
def time_buckets(spark, sf_dir):
    return stats.timeline(parsed(spark, sf_dir, time=True, wanted=["timestamp", "log_level"]), f("level"), 48)


@query("SELECT user_id::VARCHAR AS value, count(*) AS entries FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", name="top_values")
def frequent(spark, sf_dir):
    return stats.top_values(parsed(spark, sf_dir, wanted=["thread_id"]), f("thread"), 10)


@query(f"""SELECT concat(event_type, '.log') AS source, 'Bracketed default' AS schema_name, count(*) AS entries,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM events GROUP BY event_type""", name="source_summary")
def summary(spark, sf_dir):
    df = stats.source_summary(parse(event_log(spark, sf_dir, per_type=True), BRACKETED, wanted=["timestamp"]))
    return df.withColumns({c: text(F.col(c)) for c in ("first_ts", "last_ts")})


@query("SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM events", name="log_span")
def span(spark, sf_dir):
    df = stats.log_span(parsed(spark, sf_dir, time=True, wanted=["timestamp"]))
    return df.select(text(F.col("first_ts")).alias("first_ts"), text(F.col("last_ts")).alias("last_ts"))


# ---- joins --------------------------------------------------------------------------

_MARKS = "SELECT concat('doc-', doc_id) AS source, (1 + quality)::BIGINT AS line_no, concat('toxic ', toxic) AS note FROM labels"


def _bookmarks(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc-"), "doc_id").alias("source"),
        (1 + F.col("quality")).cast("long").alias("line_no"),
        F.concat(F.lit("toxic "), "toxic").alias("note"),
    )


_STARTS_SQL = fold_sql("regexp_matches(value, '^[A-M]')")


@query(_STARTS_SQL + f" SELECT source, entry_index, line_no, note FROM folded JOIN ({_MARKS}) USING (source, line_no)")
def bookmarks(spark, sf_dir):
    entries = fold_entries(document_lines(spark, sf_dir), STARTS)
    return with_bookmarks(entries, _bookmarks(spark, sf_dir)).select("source", "entry_index", "line_no", "note")


@query(f"SELECT * FROM ({_MARKS}) WHERE source IN (SELECT concat('doc-', doc_id) FROM documents WHERE lang = 'en')")
def bookmark_prune(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return prune_bookmarks(_bookmarks(spark, sf_dir), docs.select(F.concat(F.lit("doc-"), "doc_id").alias("source"))).select(
        "source", "line_no", "note"
    )


@query(_STARTS_SQL + """ SELECT lang, origin, count(*) AS entries FROM folded
  JOIN (SELECT concat('doc-', doc_id) AS source, lang, source AS origin FROM documents) USING (source) GROUP BY ALL""")
def source_info(spark, sf_dir):
    info = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("source"), "lang", F.col("source").alias("origin")
    )
    entries = fold_entries(document_lines(spark, sf_dir), STARTS)
    return with_source_info(entries, info).groupBy("lang", "origin").agg(F.count(F.lit(1)).alias("entries"))


@query("""SELECT name, tier, path FROM (SELECT concat(lang, '-', n_chars % 50) AS name, (doc_id % 4)::INT AS tier, doc_id AS path,
  row_number() OVER (PARTITION BY concat(lang, '-', n_chars % 50) ORDER BY doc_id % 4, doc_id) AS nth FROM documents) WHERE nth = 1""")
def tier_precedence(spark, sf_dir):
    library = table(spark, sf_dir, "documents").select(
        F.expr("concat(lang, '-', n_chars % 50)").alias("name"),
        (F.col("doc_id") % 4).cast("int").alias("tier"),
        F.col("doc_id").alias("path"),
    )
    return first_by_name(library)

