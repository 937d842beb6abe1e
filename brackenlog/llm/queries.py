"""The operators of this folder as registered queries over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from brackenlog.catalog import query
from brackenlog.catalog.logs import table
from brackenlog.llm import conversation_repair, lang_id, mixing, pieces, token_store, toxicity, url_filter, warc
from brackenlog.llm.near_dedup import near_duplicates
from brackenlog.llm.quality import judge
from brackenlog.llm.substring_dedup import dedup_substrings
from brackenlog.llm.vector_dedup import near_duplicate_vectors
from brackenlog.llm.whitening import whiten
from brackenlog.session import fresh_dir

_WORDS_SQL = r"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"



@query()
def op1_lang_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", lang_id.held_out("doc_id"))
    net = lang_id.train(docs.where("NOT held_out").select("text", "lang"))
    return lang_id.predict(docs.select("doc_id", "text", "held_out"), net).select("doc_id", "held_out", "lang_pred", "score")


@query(
    rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS_SQL.format(text="text")} AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
h AS (SELECT r, i, doc_id, array_to_string(w[i:i + 12], ' ') AS s FROM p),
m AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY s) AS hit FROM h),
u AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
c AS (SELECT u.r, u.doc_id, u.word, u.i,
  coalesce(max(m.hit::INT) OVER (PARTITION BY u.r ORDER BY u.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM u LEFT JOIN m ON u.r = m.r AND u.i = m.i),
g AS (SELECT r, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r"""
)
def op2_substring_dedup(spark, sf_dir):
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_BASE32_SQL = """translate({x}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"""
_DIGEST_SQL = _BASE32_SQL.format(x=" || ".join(f"lpad(to_base(('0x' || sha1(html)[{1 + 10 * k}:{10 + 10 * k}])::BIGINT, 32), 8, '0')" for k in range(4)))


@query(
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_DIGEST_SQL} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM m"""
)
def op3_warc(spark, sf_dir):
    folder = fresh_dir(spark, "warc")
    warc.write(warc.decide(table(spark, sf_dir, "pages")), folder)
    return warc.pages(warc.read(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    rf"""WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""
)
def op4_lsh_forest(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query(
    """WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(a, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT x.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, x.vec_id) AS component_id, coalesce(c.c, x.vec_id) = x.vec_id AS kept
FROM embeddings x LEFT JOIN c ON c.a = x.vec_id LEFT JOIN n ON n.a = x.vec_id"""
)
def op5_pivot_permutation(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op6_sentencepiece(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op7_token_store(spark, sf_dir):
    folder = fresh_dir(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


URL_RULES = [
    url_filter.UrlRule("allow", "org/"),
    url_filter.UrlRule("block", "example.org/es/"),
    url_filter.UrlRule("block", "example.org/en/1"),
    url_filter.UrlRule("allow", "com/fr/"),
    url_filter.UrlRule("block", "com/de/"),
]


@query()
def op8_link_graph_filter(spark, sf_dir):
    judged = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@query()
def op9_systematic_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("words"))
    mixed = mixing.mix(docs, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op10_adaptive_quality(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op11_noisy_channel_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id")).select("doc_id", "toxic")
    model = toxicity.train(docs, labels, toxicity.language_model(docs))
    judged = toxicity.predict(docs, model).withColumn("held_out", toxicity.held_out("doc_id"))
    return judged.select("doc_id", "held_out", "score", "predicted")


# Turn by turn instead of span by span: the least (cost, audit, repaired lines) for each situation
# (0 start, 1 after system, 2 after user, 3 after assistant), with chains of inserted turns.
@query(
    r"""WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
b AS (SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, [ascii(key[i])::UBIGINT FOR i IN range(1, strlen(key) + 1)]),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0::UBIGINT FOR j IN range(8)]),
      lambda d, e: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS c FROM k),
f AS (SELECT *, xor(c, 4294967295::UBIGINT) % 20 AS fate FROM b),
m AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM m),
t AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(seen AND NOT blank) AS duplicate,
    count_if(cut AND NOT seen AND NOT blank) AS truncated, count_if(i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM t GROUP BY conv_id),
chain(p, q, cost, audit, turns) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']),
    (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
step(r, role, p, q) AS (VALUES ('s', 'system', 0, 1), ('u', 'user', 0, 2), ('u', 'user', 1, 2), ('u', 'user', 3, 2), ('a', 'assistant', 2, 3)),
e AS (
  SELECT conv_id, i, p, p AS q, 4 AS cost, 'D' AS audit, []::VARCHAR[] AS turns FROM t, (VALUES (0), (1), (2), (3)) v(p)
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN cut THEN 3 ELSE 0 END, 'K', [t.role || ':' || text] FROM t JOIN step ON t.r = step.r WHERE NOT blank AND NOT seen
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN cut THEN 6 ELSE 3 END, 'R', [step.role || ':' || text] FROM t, step WHERE NOT blank AND NOT seen AND step.r <> 's'),
x AS (SELECT conv_id, i, chain.p, e.q, chain.cost + e.cost AS cost, chain.audit || e.audit AS audit, list_concat(chain.turns, e.turns) AS turns FROM e JOIN chain ON chain.q = e.p),
dp(conv_id, i, q, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'turns': []::VARCHAR[]} FROM t
  UNION ALL
  SELECT dp.conv_id, x.i, x.q, min({'cost': best.cost + x.cost, 'audit': best.audit || x.audit, 'turns': list_concat(best.turns, x.turns)})
  FROM dp JOIN x ON x.conv_id IS NOT DISTINCT FROM dp.conv_id AND x.i = dp.i + 1 AND x.p = dp.q GROUP BY ALL),
z AS (SELECT s.conv_id, min({'cost': best.cost + chain.cost, 'audit': best.audit || chain.audit, 'turns': list_concat(best.turns, chain.turns)}) AS best
  FROM dp JOIN s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = s.n JOIN chain ON chain.p = dp.q AND chain.q IN (0, 3) GROUP BY s.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""
)
def op12_conversation_repair(spark, sf_dir):
    found = conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", *conversation_repair.COUNTS, "gaps", "cost", "audit", "repaired_sha256")


@query()
def op13_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
