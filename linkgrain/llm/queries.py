"""The opN queries: each applies its operator to the whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, html_text, language, mix, near, spelling, suffix, tokens, topk, toxicity, warc, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark, sf_dir):
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op6_topk_search(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_source_mix(spark, sf_dir):
    return mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark, sf_dir):
    return language.predicted_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark, sf_dir):
    rows = whiten.whitened(table(spark, sf_dir, "embeddings"), scale=64.0, components=32)
    component = F.posexplode(F.arrays_zip("coordinates", "explained")).alias("component", "c")
    return rows.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", component).select("vec_id", (F.col("component") + 1).alias("component"), "n", "deviation", F.col("c.coordinates").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def op12_fingerprints(spark, sf_dir):
    rows = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    text, likeness = fingerprints.as_string, fingerprints.likeness
    return rows.select("doc_id", "n_chars", "edited_sha256", text(F.col("sketch")).alias("fingerprint"), text(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op13_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_near_duplicates, op3_token_counts, op4_toxicity, op5_html_text, op6_topk_search, op7_source_mix, op8_language_id, op9_warc, op10_decontamination, op11_whitening, op12_fingerprints, op13_spelling)}

OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, sum(size) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sizes GROUP BY source),
ranked AS (
  SELECT *, 3 * s / w AS level, sum(s) OVER () AS everything,
    coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM per),
leveled AS (SELECT *, max(CASE WHEN (everything - capped) / rest <= level THEN (everything - capped) / rest END) OVER () AS water FROM ranked),
targets AS (SELECT source, s, least(CAST(3 * s AS DOUBLE), CAST(water * w AS DOUBLE)) AS target FROM leveled),
placed AS (
  SELECT d.doc_id, d.size, CAST(t.s AS BIGINT) AS source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, words - before)) + greatest(0, least(size, words - source_size - before)) + greatest(0, least(size, words - 2 * source_size - before)) AS BIGINT) AS taken
FROM placed
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY sha256(html)) AS first FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS INTEGER) >> (15 - 5 * (i % 4))::INT) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs) WHERE rank <= 5
"""

OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
classes AS (SELECT list_sort(s) AS k, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
items AS (SELECT id, n, unnest(k) AS x FROM classes),
shared AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
named AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(m.component, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.k LEFT JOIN named m ON m.id = c.id
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM d),
e AS (SELECT *, CASE WHEN n // 3 = 0 THEN text ELSE substring(text, 1, n - n // 3) || substring(next, 1, n // 3) END AS edited FROM n),
texts AS (SELECT doc_id, 'own' AS kind, text AS t FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e),
words AS (SELECT doc_id, kind, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM texts),
hashed AS (SELECT doc_id, kind, list_transform(range(1, len(w) + 1), lambda i: substring(md5(array_to_string(w[greatest(1, i - 4):i], ' ')), 1, 12)) AS h FROM words),
below AS (SELECT *, list_sort(list_distinct(list_filter(h, lambda x: x < '400000000000'))) AS b FROM hashed),
sketches AS (SELECT doc_id, kind, CASE WHEN len(b) > 0 OR len(h) = 0 THEN b ELSE [list_min(h)] END AS s FROM below),
three AS (
  SELECT e.doc_id, e.n, e.edited, o.s, x.s AS es,
    coalesce(lead(o.s) OVER (ORDER BY e.doc_id DESC), first_value(o.s) OVER (ORDER BY e.doc_id DESC)) AS ns
  FROM e JOIN sketches o ON o.doc_id = e.doc_id AND o.kind = 'own' JOIN sketches x ON x.doc_id = e.doc_id AND x.kind = 'edited')
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(es, '') AS edited_fingerprint,
  CASE WHEN len(s) + len(es) = 0 THEN 1.0 ELSE len(list_intersect(s, es))::DOUBLE / (len(s) + len(es) - len(list_intersect(s, es))) END AS near_edited,
  CASE WHEN len(s) + len(ns) = 0 THEN 1.0 ELSE len(list_intersect(s, ns))::DOUBLE / (len(s) + len(ns) - len(list_intersect(s, ns))) END AS near_next
FROM three
"""

OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) GROUP BY ALL),
crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) g(i)),
bytes AS (
  SELECT run, times, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c)::BIGINT // 64, 128 + ord(c)::BIGINT % 64] END))) AS b
  FROM runs WHERE length(run) >= 7),
hashed AS (SELECT run, times, xor(list_reduce(b, lambda a, x: xor(a // 256, t[xor(a, x) % 256 + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT DISTINCT word, n, substring(word, 1, i - 1) || substring(word, i + 1) AS k FROM places),
opened AS (SELECT word, n, substring(word, 1, i - 1) || '*' || substring(word, i + 1) AS k FROM places),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM opened a JOIN opened b ON a.k = b.k AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.k = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.k = w.word),
best AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, min(other) FILTER (n = top) AS form, max(n) AS form_n FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
way AS (SELECT word, word AS at, form AS further FROM forms UNION ALL SELECT way.word, f.word, f.form FROM way JOIN forms f ON f.word = way.further)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON way.word = f.word AND way.further IS NULL
"""

SQL = {"op12_fingerprints": OP12_SQL, "op13_spelling": OP13_SQL, "op2_near_duplicates": OP2_SQL, "op6_topk_search": OP6_SQL, "op7_source_mix": OP7_SQL, "op9_warc": OP9_SQL}
