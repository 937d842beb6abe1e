"""Message templates and pattern ladders over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackenlog.catalog import query
from brackenlog.catalog.entries import LOG, f
from brackenlog.catalog.filters import parsed
from brackenlog.catalog.logs import spread, table, text
from brackenlog.functions.text import shape_of, strip_affix
from brackenlog.operators.ladder import exact_alternations as exact_patterns_of, pattern_ladder, rank_ladder
from brackenlog.operators.mining import message_template, templates
from brackenlog.session import fresh_dir

_CLING = r"[,;:=()\[\]{}<>!?#]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_ESC = r"regexp_replace({0}, '([\\.+*?()|\[\]{{}}^$#&~-])', '\\\1', 'g')"


def _class_sql(core: str) -> str:
    return rf"""CASE WHEN {core} = '' THEN NULL
      WHEN regexp_full_match({core}, '{_UUID}') THEN '{_UUID}'
      WHEN regexp_full_match({core}, '{_IP}') THEN '\d{{1,3}}(?:\.\d{{1,3}}){{3}}'
      WHEN regexp_full_match({core}, '0[xX][0-9a-fA-F]+') THEN '0[xX][0-9a-fA-F]+'
      WHEN regexp_full_match({core}, '[0-9]+') THEN '\d+'
      WHEN regexp_full_match({core}, '[0-9]+[.,][0-9]+') THEN '\d+[.,]\d+'
      WHEN regexp_full_match({core}, '[0-9a-fA-F]{{6,}}') AND regexp_matches({core}, '[0-9]') AND regexp_matches({core}, '[a-fA-F]') THEN '[0-9a-fA-F]+'
      WHEN regexp_full_match({core}, '''\S*''') AND length({core}) > 1 THEN '''[^'']*'''
      WHEN regexp_full_match({core}, '"\S*"') AND length({core}) > 1 THEN '"[^"]*"' END"""


def template_sql(rows: str) -> str:
    """CTEs from ``rows`` (id, msg) to ``mined`` (id, template)."""
    shapes = rf"""{_UUID}|{_IP}|0[xX][0-9a-fA-F]+|[0-9]+[.,][0-9]+|[0-9]+|[0-9a-fA-F]{{6,}}|''\S*''|"\S*\""""
    return rf"""msgs AS ({rows}),
  cut AS (SELECT id, msg, string_split_regex(regexp_replace(msg, '^\s+|\s+$', '', 'g'), '\s+') AS parts FROM msgs WHERE regexp_matches(msg, '\S')),
  toks AS (SELECT id, msg, unnest(parts) AS tok, generate_subscripts(parts, 1) AS i FROM cut),
  split AS (SELECT *, regexp_extract(tok, '^((?:\S*?{_CLING})??)({shapes})({_CLING}*)$', ['h', 'c', 't']) AS p FROM toks),
  classed AS (SELECT *, {_class_sql('p.c')} AS cls FROM split),
  pieces AS (SELECT id, msg, i, CASE WHEN cls IS NULL THEN {_ESC.format('tok')} ELSE concat({_ESC.format('p.h')}, cls, {_ESC.format('p.t')}) END AS piece,
    cls IS NULL OR p.h <> '' OR p.t <> '' AS anchored FROM classed),
  mined AS (SELECT id, any_value(msg) AS msg, CASE WHEN bool_or(anchored) THEN string_agg(piece, '\s+' ORDER BY i)
    ELSE {_ESC.format(r"regexp_replace(any_value(msg), '^\s+|\s+$', '', 'g')")} END AS template FROM pieces GROUP BY id)"""


@query(LOG + ", " + template_sql("SELECT event_id AS id, message AS msg FROM log") + " SELECT id AS entry_index, template FROM mined")
def message_templates(spark, sf_dir):
    df = parsed(spark, sf_dir, wanted=["message"])
    return df.select("entry_index", message_template(f("message")).alias("template"))


@query(LOG + ", " + template_sql("SELECT event_id AS id, message AS msg FROM log") + """
  SELECT template, count(*) AS entries, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts,
    strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts, arg_min(msg, id) AS example
  FROM mined JOIN events ON id = event_id GROUP BY template""")
def template_counts(spark, sf_dir):
    df = templates(parsed(spark, sf_dir, time=True, wanted=["timestamp", "message"]), f("message"), "entry_index")
    return df.withColumns({c: text(F.col(c)) for c in ("first_ts", "last_ts")})


@query("WITH " + template_sql("SELECT item_id AS id, text AS msg FROM benchmark") + " SELECT id AS item_id, md5(template) AS template_md5 FROM mined")
def passage_templates(spark, sf_dir):
    df = table(spark, sf_dir, "benchmark").select("item_id", message_template(F.col("text")).alias("t"))
    return df.filter("t IS NOT NULL").select("item_id", F.md5("t").alias("template_md5"))


@query(rf"""WITH toks AS (SELECT unnest(string_split_regex(text, '\s+')) AS tok FROM documents),
  cores AS (SELECT regexp_replace(tok, '^{_CLING}+|{_CLING}+$', '', 'g') AS core FROM toks WHERE tok <> ''),
  named AS (SELECT CASE WHEN regexp_full_match(core, '{_UUID}') THEN 'uuid' WHEN regexp_full_match(core, '{_IP}') THEN 'ipv4'
    WHEN regexp_full_match(core, '0[xX][0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match(core, '[0-9]+') THEN 'integer'
    WHEN regexp_full_match(core, '[0-9]+[.,][0-9]+') THEN 'decimal'
    WHEN regexp_full_match(core, '[0-9a-fA-F]{{6,}}') AND regexp_matches(core, '[0-9]') AND regexp_matches(core, '[a-fA-F]') THEN 'bare_hex'
    WHEN regexp_full_match(core, '''\S*''') AND length(core) > 1 THEN 'single_quoted'
    WHEN regexp_full_match(core, '"\S*"') AND length(core) > 1 THEN 'double_quoted' ELSE 'word' END AS shape FROM cores)
  SELECT shape, count(*) AS tokens FROM named GROUP BY 1""")
def token_shapes(spark, sf_dir):
    tokens = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(F.split("text", r"\s+")).alias("tok")).filter("tok <> ''")
    shape = F.coalesce(shape_of(strip_affix(F.col("tok"))), F.lit("word"))
    return tokens.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("tokens"))


def _selections(spark, sf_dir):
    """Messages of one user and level are a selection; there are as many as users."""
    df = parsed(spark, sf_dir, wanted=["thread_id", "log_level", "message"])
    key = F.concat(f("thread"), F.lit(" "), f("level"))
    messages = df.select(key.alias("key"), F.col("entry_index").alias("order"), f("message").alias("message"))
    folder = fresh_dir(spark, "messages")
    messages.write.parquet(folder)  # the ladder reads them several times; parse them once
    return spark.read.parquet(folder)


@query(name="pattern_ladder")
def ladders(spark, sf_dir):
    return pattern_ladder(_selections(spark, sf_dir))


@query()
def default_patterns(spark, sf_dir):
    return pattern_ladder(_selections(spark, sf_dir)).filter("is_default").select("key", "rung", "pattern")


@query()
def ranked_ladder(spark, sf_dir):
    messages = _selections(spark, sf_dir)
    return rank_ladder(pattern_ladder(messages), messages)


_ESC_MSG = _ESC.format(r"regexp_replace(message, '^\s+|\s+$', '', 'g')")


@query(LOG + f""", seen AS (SELECT concat(user_id, ' ', level) AS key, {_ESC_MSG} AS text, min(event_id) AS nth FROM log GROUP BY ALL)
  SELECT key, concat('(?:', string_agg(text, '|' ORDER BY nth), ')') AS pattern FROM seen GROUP BY key""")
def exact_patterns(spark, sf_dir):
    """The exact rung of every selection."""
    return exact_patterns_of(_selections(spark, sf_dir)).select("key", F.concat(F.lit("(?:"), "exact", F.lit(")")).alias("pattern"))

