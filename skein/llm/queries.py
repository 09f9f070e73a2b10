"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, decontamination, html_text, language_id, licenses, mixing, ngram_jaccard, quality_rules, sentence_spans, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_stupid_backoff(spark, sf_dir):
    s = backoff_lm.score(table(spark, sf_dir, "documents"))
    return s.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log")})


def op2_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentence_spans(spark, sf_dir):
    return sentence_spans.dedup(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_stupid_backoff, op2_html_extraction, op3_language_id, op4_license_scan, op5_decontamination, op6_source_mixing, op7_quality_rules, op8_sentence_spans, op9_ngram_jaccard, op10_warc)}
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

#: Counterparts where SQL can express a query; ids are taken as unique.
ORACLES: dict[str, str] = {
    "op1_stupid_backoff": f"""
WITH l AS (SELECT doc_id, {_WORDS.format(text="text")} AS ws FROM documents),
t AS MATERIALIZED (SELECT doc_id, p, ws[p] AS c, ws[p - 1] AS b, ws[p - 2] AS a, len(ws) AS n FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM l)),
g AS (SELECT doc_id, n, p, c AS k1, CASE WHEN p > 1 THEN b || ' ' || c END AS k2, CASE WHEN p > 2 THEN a || ' ' || b || ' ' || c END AS k3, b AS u2, CASE WHEN p > 2 THEN a || ' ' || b END AS u3 FROM t),
o AS MATERIALIZED (SELECT doc_id, k, count(*) AS own FROM (SELECT doc_id, k1 AS k FROM g UNION ALL SELECT doc_id, k2 FROM g WHERE k2 IS NOT NULL UNION ALL SELECT doc_id, k3 FROM g WHERE k3 IS NOT NULL) GROUP BY 1, 2),
r AS MATERIALIZED (SELECT doc_id, k, sum(own) OVER (PARTITION BY k) - own AS rest FROM o),
x AS (SELECT g.doc_id, g.p, g.n, r1.rest AS r1, coalesce(r2.rest, 0) AS r2, coalesce(r3.rest, 0) AS r3, v2.rest AS v2, v3.rest AS v3, greatest(1, (SELECT count(*) FROM t) - g.n) AS left_over
      FROM g JOIN r r1 ON r1.doc_id = g.doc_id AND r1.k = g.k1 LEFT JOIN r r2 ON r2.doc_id = g.doc_id AND r2.k = g.k2 LEFT JOIN r r3 ON r3.doc_id = g.doc_id AND r3.k = g.k3
      LEFT JOIN r v2 ON v2.doc_id = g.doc_id AND v2.k = g.u2 LEFT JOIN r v3 ON v3.doc_id = g.doc_id AND v3.k = g.u3),
y AS (SELECT doc_id, CASE WHEN r3 > 0 THEN ln(r3 / v3) WHEN r2 > 0 THEN ln(r2 / v2) + (least(p, 3) - 2) * ln(0.4::DOUBLE) WHEN r1 > 0 THEN ln(r1 / left_over) + (least(p, 3) - 1) * ln(0.4::DOUBLE) ELSE (least(p, 3) - 1) * ln(0.4::DOUBLE) - ln(left_over) END AS s, (r3 > 0)::INT AS hit, (r1 = 0)::INT AS unseen FROM x)
SELECT doc_id, len(ws) AS n_words, round(coalesce(sum(s), 0), 6) AS log_score, round(sum(s) / nullif(len(ws), 0), 6) AS mean_log, CAST(coalesce(sum(hit), 0) AS BIGINT) AS n_hits, CAST(coalesce(sum(unseen), 0) AS BIGINT) AS n_unseen FROM l LEFT JOIN y USING (doc_id) GROUP BY doc_id, ws""",
    "op9_ngram_jaccard": f"""
WITH RECURSIVE l AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM l WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
c AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c.k >= 85 * (x.k + y.k - c.k)),
r AS (SELECT doc_id, doc_id AS root FROM l UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id)
SELECT l.doc_id, coalesce(any_value(n.k), 0) AS n_shingles, min(r.root) AS component_id FROM l JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "op10_warc": """
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN last END AS refers_to
FROM (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER w AS last, octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER w AS revisit FROM pages WINDOW w AS (PARTITION BY coalesce(html, '')))""",
}
