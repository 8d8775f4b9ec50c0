"""The registered queries of the corpus operators: each applies its operator to its whole table. And DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, class_ngrams, filter_audit, media, packing, pii, quotes, simhash, spelling, token_counts, topk, toxicity, url_filter
from .common import text_or_empty

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALLOW = [("com", "/"), ("www.example.com", "/en/")]
BLOCK = [("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, WORD_VOCABULARY).drop("text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    allow, block = (url_filter.rules_frame(spark, r) for r in (ALLOW, BLOCK))
    return url_filter.judged(pages, allow, block).drop("url")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.round_trip(F.col("text"), BYTE_VOCABULARY).alias("r"))
    return both.select("doc_id", F.size("r.ids").cast("long").alias("n_tokens"), "r.ids_sha256", F.sha2("r.bytes", 256).alias("decoded_sha256"))


def op4_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = media.page_sequences(*media.pages_with_media(docs))
    n_bytes = F.split("caption", " ")[0].cast("long").alias("n_bytes")
    return found.select("doc_id", n_bytes, "probe.*", "position", "items", "caption", "n_media", "sequence_sha256")


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(quotes.as_mail(table(spark, sf_dir, "conversations")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", pii.spans(F.col("text")).alias("found"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["base"])

    def number(kind: str):
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return docs.select("doc_id", *map(number, pii.KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels)
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(text_or_empty(), lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngrams.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_url_filter, op3_byte_bpe, op4_media_sequences, op5_quotation_linking, op6_pii, op7_exact_topk, op8_best_fit_packing, op9_toxicity, op10_simhash, op11_class_ngrams, op12_filter_audit, op13_spelling_variants, pipeline)
    return {f.__name__: f for f in ops}


OP2_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS rn
  FROM cut LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE rn = 1
"""

OP5_SQL = r"""
WITH RECURSIVE plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, count(*) AS n FROM conversations GROUP BY 1, 2, 3, 4),
first AS (SELECT conv_id, turn, min(text) AS text FROM plain WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
mail AS (
  SELECT row_number() OVER (ORDER BY turn, md5(role || ':' || text)) AS id, * FROM (
    SELECT m.conv_id, m.turn, m.role, m.n,
           CASE WHEN b.text IS NOT NULL THEN '> > ' || replace(b.text, chr(10), chr(10) || '> > ') || chr(10) ELSE '' END
           || CASE WHEN a.text IS NOT NULL THEN '> ' || replace(a.text, chr(10), chr(10) || '> ') || chr(10) ELSE '' END || m.text AS text
    FROM plain m LEFT JOIN first a ON a.conv_id = m.conv_id AND a.turn + 1 = m.turn LEFT JOIN first b ON b.conv_id = m.conv_id AND b.turn + 2 = m.turn) x),
line AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM mail),
leveled AS (
  SELECT id, line, line_no, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(translate(regexp_replace(line, '^[ \t]*(>[ \t]*)+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r]+', ' ', 'g'), ' ') AS bare FROM line),
changed AS (SELECT *, CAST(level IS DISTINCT FROM lag(level) OVER (PARTITION BY id ORDER BY line_no) AS INT) AS new FROM leveled),
run AS (SELECT c.*, m.conv_id, m.turn, sum(new) OVER (PARTITION BY c.id ORDER BY line_no) AS place FROM changed c JOIN mail m ON m.id = c.id),
passage AS (SELECT id, conv_id, turn, place, level, string_agg(bare, ' ' ORDER BY line_no) AS passage FROM run WHERE bare <> '' GROUP BY ALL),
whole AS (
  SELECT q.id, q.place, q.level, max(o.id) AS origin
  FROM passage q LEFT JOIN passage o ON o.conv_id = q.conv_id AND o.passage = q.passage AND o.level = 0 AND o.turn < q.turn WHERE q.level > 0 AND q.conv_id IS NOT NULL AND q.turn IS NOT NULL GROUP BY ALL),
own_line AS (SELECT DISTINCT id, conv_id, turn, bare FROM run WHERE level = 0 AND bare <> ''),
by_line AS (
  SELECT r.id, r.place, r.level, r.line_no, length(r.bare) AS size, max(o.id) AS origin
  FROM whole w JOIN run r ON r.id = w.id AND r.place = w.place AND r.bare <> ''
  JOIN own_line o ON o.conv_id = r.conv_id AND o.bare = r.bare AND o.turn < r.turn WHERE w.origin IS NULL GROUP BY ALL),
part AS (SELECT *, row_number() OVER (PARTITION BY id, place ORDER BY size DESC, origin DESC) AS rn FROM (SELECT id, place, level, origin, sum(size) AS size FROM by_line GROUP BY ALL) y),
hit AS (SELECT id, level, origin FROM whole WHERE origin IS NOT NULL UNION ALL SELECT id, level, origin FROM part WHERE rn = 1),
link AS (
  SELECT id, max(CASE WHEN level = lowest THEN origin END) AS parent, count(*) AS quoted
  FROM (SELECT *, min(level) OVER (PARTITION BY id) AS lowest FROM hit) x GROUP BY 1),
chain AS (
  SELECT id, parent AS top, 1 AS depth FROM link
  UNION ALL
  SELECT c.id, l.parent, c.depth + 1 FROM chain c JOIN link l ON l.id = c.top),
thread AS (SELECT id, min(top) AS top, max(depth) AS depth FROM chain GROUP BY 1),
own AS (SELECT id, string_agg(line, chr(10) ORDER BY line_no) AS body FROM leveled WHERE level = 0 GROUP BY 1)
SELECT m.conv_id, coalesce(h.turn, m.turn) AS thread_turn, m.turn, p.turn AS parent_turn, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth,
       CAST(coalesce(l.quoted, 0) AS BIGINT) AS quoted, m.role,
       '<|' || m.role || '|>' || chr(10) || trim(coalesce(o.body, ''), chr(10)) || chr(10) || '<|end|>' AS formatted
FROM mail m LEFT JOIN link l ON l.id = m.id LEFT JOIN mail p ON p.id = l.parent LEFT JOIN thread t ON t.id = m.id LEFT JOIN mail h ON h.id = t.top LEFT JOIN own o ON o.id = m.id, range(m.n) copies
"""

OP7_SQL = """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pair AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, TRY_CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.place <> c.place WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank FROM pair WHERE score IS NOT NULL)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP12_SQL = r"""
WITH RECURSIVE shape AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+') IF w <> ''] AS words FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM shape GROUP BY text),
label AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
doc AS (
  SELECT s.part, coalesce(b.good, false) AS good, coalesce(b.toxic, false) AS toxic, concat(
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
    CASE WHEN 100 * len(regexp_replace(s.text, '[^A-Z]', '', 'g')) > 2 * length(s.text) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(s.text, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN coalesce(s.doc_id > l.least, false) THEN 'E' ELSE '' END) AS failed
  FROM shape s JOIN least l ON l.text = s.text LEFT JOIN label b ON b.doc_id = s.doc_id),
counts AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM doc GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE length(o) < 5 AND NOT contains(o, f)),
steps AS (SELECT o AS filter_order, CAST(i AS INT) AS step, substr(o, i, 1) AS f, substr(o, 1, i - 1) AS earlier FROM orders, range(1, 6) r(i) WHERE length(o) = 5),
flat AS (
  SELECT part, filter_order, step, f, n, good, toxic, failed, contains(failed, f) AS fails, length(translate(failed, earlier, '')) < length(failed) AS gone FROM counts, steps),
summed AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (failed = f), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM flat GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed
"""

OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)) x),
run AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) x GROUP BY ALL),
coded AS (SELECT doc_id, run, n, hex(concat(doc_id, ':', run)) AS x FROM run WHERE length(run) >= 5),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(x) // 2)], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, crc),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
word AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gap AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word) x),
near AS (
  SELECT g.word, w.word AS near, w.n AS near_n FROM gap g JOIN word w ON w.word = g.rest
  UNION SELECT w.word, g.word, g.n FROM gap g JOIN word w ON w.word = g.rest
  UNION SELECT a.word, b.word, b.n FROM gap a JOIN gap b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS rn FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM word w LEFT JOIN best b ON b.word = w.word AND b.rn = 1),
chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op5_quotation_linking": OP5_SQL, "op7_exact_topk": OP7_SQL, "op12_filter_audit": OP12_SQL, "op13_spelling_variants": OP13_SQL}
