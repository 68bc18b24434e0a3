"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, fingerprints, langid, licenses, mixing, packing, quality, simhash, suffixes, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE len(x) > 0 AND list_bool_and(list_transform(x, lambda e: e IS NOT NULL AND isfinite(e))) AND list_max(list_transform(x, lambda e: abs(e))) > 0
), l AS (
  SELECT a.row AS a, b.row AS b, b.vec_id AS b_id FROM ok a JOIN ok b ON a.row <> b.row AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), r AS (
  SELECT row AS a, row AS b, vec_id AS id FROM v UNION SELECT r.a, l.b, l.b_id FROM r JOIN l ON l.a = r.b
), c AS (
  SELECT a AS row, min(id) AS component_id FROM r GROUP BY a
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.row) AS n_links, c.component_id, coalesce(v.vec_id = c.component_id, false) AS kept
FROM v JOIN c ON c.row = v.row
"""


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.labelled_urls(spark))
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), model).drop("url")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = mixing.mix_plan(table(spark, sf_dir, "documents"))
    rows = per.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST((rank - 1) % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s
), f AS (
  SELECT *, CAST(total - (sum(cap) OVER o - cap) AS DOUBLE) / CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS DOUBLE) AS lam
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT lam AS level FROM f WHERE lam * weight <= cap ORDER BY CAST(cap AS DOUBLE) / weight, rank LIMIT 1
), t AS (
  SELECT f.*, CASE WHEN level * weight < cap THEN level * weight ELSE CAST(cap AS DOUBLE) END AS target FROM f LEFT JOIN l ON true
), q AS (
  SELECT d.*, t.rank, t.weight, t.source_size, t.target, t.total,
         sum(size) OVER (PARTITION BY t.rank ORDER BY key, doc_id, size) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT DISTINCT key, doc_id, size, rank, epoch, total,
         sum(size) OVER (PARTITION BY key, doc_id, rank, size, epoch) AS words,
         CAST(cum + epoch * source_size AS DOUBLE) / weight AS vt
  FROM q, (VALUES (0), (1), (2)) e(epoch)
), r AS (
  SELECT *, sum(words) OVER (ORDER BY vt, rank, key, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS run FROM i
), c AS (
  SELECT key, doc_id, size, rank, count(*) FILTER (WHERE run <= total) AS copies FROM r GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * c.copies AS BIGINT) AS taken
FROM q JOIN c ON q.key = c.key AND q.doc_id IS NOT DISTINCT FROM c.doc_id AND q.size = c.size AND q.rank = c.rank
"""


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs.drop("lang"), langid.learned(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (
  SELECT row, doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s
  FROM (SELECT row, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM d)
), f AS (
  SELECT s, min(doc_id) AS first FROM g GROUP BY s
), c AS (
  SELECT row, p, CASE WHEN p <= lag(p) OVER (PARTITION BY row ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh
  FROM g JOIN f USING (s) WHERE f.first < g.doc_id
), n AS (
  SELECT row, p, sum(fresh) OVER (PARTITION BY row ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM c
), r AS (
  SELECT row, span, min(p) AS lo, max(p) + 50 AS hi FROM n GROUP BY row, span
), k AS (
  SELECT row, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM r GROUP BY row
), e AS (
  SELECT row, lo AS stop, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY lo), 0) AS begin FROM r
  UNION ALL
  SELECT d.row, length(h) // 2, coalesce(max(hi), 0) FROM d LEFT JOIN r ON r.row = d.row GROUP BY d.row, h
), t AS (
  SELECT e.row, string_agg(substr(d.h, CAST(2 * begin + 1 AS BIGINT), CAST(2 * (stop - begin) AS BIGINT)), '' ORDER BY begin, stop) AS kept
  FROM e JOIN d ON d.row = e.row GROUP BY e.row
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(t.kept)) AS kept_sha256
FROM d JOIN t ON t.row = d.row LEFT JOIN k ON k.row = d.row
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.learned(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def _license_sql() -> str:
    rows = []
    for exact, phrases in (("true", licenses.BASE), ("false", licenses.NOTICES)):
        for label, text in phrases.items():
            w = text.split()
            rows += [f"('{w[i]} {w[i + 1]}', '{label} {exact}', '{label}', {exact}, {i}, {len(w) - 1})" for i in range(len(w) - 1)]
    return f"""
WITH t(pair, template, label, exact, place, pairs) AS (VALUES {", ".join(rows)}
), d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT row, spot, w[spot + 1] || ' ' || w[spot + 2] AS pair FROM (SELECT row, w, unnest(range(0, greatest(len(w) - 1, 0))) AS spot FROM d)
), h AS (
  SELECT DISTINCT g.row, t.template, t.label, t.exact, t.pairs, spot - place AS diagonal, place FROM g JOIN t ON t.pair = g.pair
), v AS (
  SELECT row, template, label, exact, pairs, diagonal, count(*) AS seen FROM h GROUP BY ALL
), b AS (
  SELECT row, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM v WHERE exact AND seen = pairs GROUP BY row
), m AS (
  SELECT v.row, v.label, v.diagonal, v.template, v.seen, v.pairs, count(DISTINCT h.place) AS merged FROM v JOIN h ON h.row = v.row AND h.template = v.template AND abs(h.diagonal - v.diagonal) <= {licenses.DRIFT}
  WHERE NOT v.exact GROUP BY ALL
), k AS (
  SELECT m.row, m.label, CAST(m.merged AS DOUBLE) / m.pairs AS cover, m.seen >= (SELECT max(o.seen) FROM m o WHERE o.row = m.row AND o.template = m.template AND abs(o.diagonal - m.diagonal) <= {licenses.DRIFT}) AS peak FROM m
), a AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
    SELECT row, label FROM v WHERE exact AND seen = pairs UNION SELECT row, label FROM k WHERE peak AND cover >= {licenses.COVER}) GROUP BY row
), s AS (SELECT row, max(cover) AS best FROM k GROUP BY row)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN b ON b.row = d.row LEFT JOIN a ON a.row = d.row LEFT JOIN s ON s.row = d.row
"""


QUERIES: dict[str, Query] = {
    "op1_embeddings": op1_embeddings,
    "op2_urls": op2_urls,
    "op3_mixing": op3_mixing,
    "op4_langid": op4_langid,
    "op5_suffixes": op5_suffixes,
    "op6_packing": op6_packing,
    "op7_licenses": op7_licenses,
    "op8_simhash": op8_simhash,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {
    "op1_embeddings": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op5_suffixes": OP5_SQL,
    "op7_licenses": _license_sql(),
}
