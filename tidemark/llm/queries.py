"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, divergence, infill, jaccard, langid, lines, mixing, mtree, quality, sharding, toxicity, urls
from tidemark.llm.labelled_urls import LABELLED, SCHEMA
from tidemark.llm.learn import fold
from tidemark.llm.text import small_batches
from tidemark.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labels(spark: SparkSession, sf_dir: str, folds: int, held: int) -> DataFrame:
    """The labels without the held-out fold."""
    return table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), folds) != held)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _labels(spark, sf_dir, 5, 0))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), quality.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.exact_top(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = docs.select("doc_id", bpe.encode("text", path, docs).alias("ids"))
    return ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode(bpe.decode("ids", path, docs), "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sized")
    planned = mixing.plan_mixture(sized)
    return planned.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.filter(~held))
    found = docs.select("doc_id", held.alias("held_out"), langid.predict("text", model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.accepted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _labels(spark, sf_dir, 4, 2))
    held = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    scored = docs.select("doc_id", held, toxicity.judge("text", model).alias("t")).select("doc_id", "held_out", "t.score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.similar_documents(docs).select("doc_id", "n_shingles", "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard_documents(docs, sharding.topology(8))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restore("output", "form")).alias("restored_sha256"))


URL_RULES = (
    urls.Rule("org", "/", urls.ALLOW),
    urls.Rule("example.org", "/es/", urls.BLOCK),
    urls.Rule("example.org", "/en/1", urls.BLOCK),
    urls.Rule("com", "/fr/", urls.ALLOW),
    urls.Rule("com", "/de/", urls.BLOCK),
)


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit(spark.createDataFrame(LABELLED, SCHEMA))
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), model, URL_RULES).drop("url")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_ann": op2_ann,
    "op3_line_chunks": op3_line_chunks,
    "op4_mtree": op4_mtree,
    "op5_bpe": op5_bpe,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard": op9_jaccard,
    "op10_sharding": op10_sharding,
    "op11_infill": op11_infill,
    "op12_urls": op12_urls,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op3_line_chunks": """
WITH d AS (SELECT DISTINCT doc_id, text, coalesce(md5(text), '') AS digest, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, digest, lines, unnest(range(len(lines))) AS i FROM d),
h AS (SELECT *, CAST('0x' || md5(lines[i + 1])[1:6] AS BIGINT) AS h, length(lines[i + 1]) AS size FROM l),
b AS (SELECT *, lag(h) OVER w AS before, lag(size) OVER w AS size_before FROM h WINDOW w AS (PARTITION BY doc_id, digest ORDER BY i)),
c AS (SELECT *, i > 0 AND ((h + 31 * before) % 8 <> 0 OR h = before) AS cut FROM b),
k AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id, digest ORDER BY i) AS chunk FROM c),
s AS (SELECT doc_id, digest, i AS start, i AS stop FROM c WHERE size >= 120
  UNION ALL SELECT doc_id, digest, i - 1, i FROM c WHERE cut AND size_before + 1 + size >= 20
  UNION ALL SELECT doc_id, digest, min(i), max(i) FROM k GROUP BY doc_id, digest, chunk HAVING count(*) > 1 AND sum(size) + count(*) - 1 >= 20),
u AS (SELECT s.*, array_to_string(lines[start + 1:stop + 1], chr(10)) AS unit FROM s JOIN d ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.digest = d.digest),
f AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id NULLS LAST, digest, start) > 1 AS later FROM u),
g AS (SELECT doc_id, digest, count(*) AS removed_chunks FROM f WHERE later GROUP BY ALL),
x AS (SELECT DISTINCT doc_id, digest, unnest(range(start, stop + 1)) AS i FROM f WHERE later),
t AS (SELECT l.doc_id, l.digest, count(x.i) AS removed_lines, coalesce(string_agg(CASE WHEN x.i IS NULL THEN lines[l.i + 1] END, chr(10) ORDER BY l.i), '') AS kept
  FROM l LEFT JOIN x ON l.doc_id IS NOT DISTINCT FROM x.doc_id AND l.digest = x.digest AND l.i = x.i GROUP BY ALL)
SELECT o.doc_id, CASE WHEN removed_chunks IS NOT NULL THEN kept ELSE o.text END AS text, CAST(coalesce(len(string_split(o.text, chr(10))), 0) AS INT) AS n_lines,
  CAST(coalesce(removed_chunks, 0) AS INT) AS removed_chunks, CAST(coalesce(removed_lines, 0) AS INT) AS removed_lines
FROM documents o LEFT JOIN t ON o.doc_id IS NOT DISTINCT FROM t.doc_id AND coalesce(md5(o.text), '') = t.digest
LEFT JOIN g ON o.doc_id IS NOT DISTINCT FROM g.doc_id AND coalesce(md5(o.text), '') = g.digest
""",
    "op4_mtree": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM k),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
g AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target, CASE rank % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS a FROM v),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM d),
j AS (SELECT doc_id, size, source_size, target, a, greatest(0, least(size, floor(target)::BIGINT - c::BIGINT)) AS t0,
  greatest(0, least(size, floor(target)::BIGINT - c::BIGINT - source_size)) AS t1, c / target AS u
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(t0 + t1 AS BIGINT) AS taken,
  CASE WHEN t0 > 0 THEN CASE WHEN a = 0 THEN u ELSE (sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a) END END AS position
FROM j
""",
    "op9_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS s FROM d),
k AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM n),
f AS (SELECT doc_id, unnest(s) AS g FROM n),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN k a ON a.doc_id = x JOIN k b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n_shingles + b.n_shingles - i)),
c AS (SELECT x, y FROM l UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x)
SELECT k.doc_id, n_shingles, least(k.doc_id, coalesce(min(y), k.doc_id)) AS component_id FROM k LEFT JOIN c ON c.x = k.doc_id GROUP BY k.doc_id, n_shingles
""",
    "op11_infill": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
  CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
u AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM u GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS lang_n FROM u GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, lang_n, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM x JOIN t USING (lang, source) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
""",
}
