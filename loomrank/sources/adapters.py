"""The funnel's tables as views over the input tables, in SQL that Spark and DuckDB read alike.

Times are epoch milliseconds as in the stored model; numbers with an exponent are doubles in both dialects.
Every view is a projection or a left join of its input, so filters and column pruning reach the scans.
An item's title is the first sentence of its text, its summary the whole text; operators cut it where their own rule says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()

#: "Now" of all queries: every time-dependent operator takes it as an argument.
NOW = 1706659200000
HOUR, DAY = 3600000, 86400000

_VIEWS = {
    "sources": """
      SELECT source AS source_id, n, 0.40e0 + 0.03e0 * n AS quality_prior, 0.25e0 + 0.25e0 * (n % 4) AS volume_budget,
             CASE n % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'linkblog' WHEN 2 THEN 'newsletter' ELSE 'discovery' END AS feed_type,
             CASE WHEN n % 10 = 9 THEN 'paid' ELSE 'free' END AS access, 0.05e0 + 0.01e0 * (n % 5) AS exploration_floor
      FROM (SELECT source, CAST(substr(source, 4) AS INT) AS n FROM documents WHERE source IS NOT NULL GROUP BY source) s""",
    "items": f"""
      SELECT doc_id AS item_id, source AS source_id, split_part(split_part(text, chr(10), 1), '. ', 1) AS title, text AS summary,
             n_chars AS content_chars, lang AS language,
             CASE WHEN doc_id % 37 = 0 THEN NULL ELSE {NOW} - ((doc_id * 7919) % 480) * {HOUR} END AS publication_time,
             {NOW} - ((doc_id * 7919) % 480) * {HOUR} + {HOUR} AS first_seen_at,
             CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 < 3 THEN 'rejected_rules' WHEN doc_id % 10 < 6 THEN 'triaged'
                  WHEN doc_id % 10 < 8 THEN 'deep_evaluated' ELSE 'published' END AS status,
             doc_id - doc_id % 3 AS cluster_id,
             CASE doc_id % 5 WHEN 0 THEN 'ai_product' WHEN 1 THEN 'ideas_science' WHEN 2 THEN 'games' WHEN 3 THEN 'culture' ELSE 'other' END AS category,
             ((doc_id * 104729 + 7) % 1000) / 1e3 AS free_score
      FROM documents""",
    "cheap": """
      SELECT doc_id AS item_id, CASE doc_id % 3 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'UNCERTAIN' ELSE 'DROP' END AS action,
             ((doc_id * 1299709 + 3) % 1000) / 1e3 AS triage_score, 0.52e0 AS threshold_used, ((doc_id * 1299709 + 3) % 1000) / 1e3 >= 0.52e0 AS passed,
             doc_id % 11 = 0 AS is_audit_sample, ((doc_id * 15485863) % 100) / 1e2 AS junk_probability
      FROM documents WHERE doc_id % 10 >= 3""",
    "deep": """
      SELECT d.doc_id AS item_id, ((d.doc_id * 32452843 + 11) % 1000) / 1e3 AS expected_attention_value,
             ((d.doc_id * 49979687 + 5) % 1000) / 1e3 AS novelty, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 0.8e0 ELSE 0.05e0 END AS ragebait,
             ((d.doc_id * 67867967) % 1000) / 1e3 AS duplicate_information, ((d.doc_id * 86028121) % 1000) / 1e3 AS anchor_distance
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id % 10 >= 6""",
    "published": f"""
      SELECT doc_id AS item_id, CASE doc_id % 6 WHEN 0 THEN 'essential' WHEN 1 THEN 'ai_product' WHEN 2 THEN 'ideas_science' WHEN 3 THEN 'games'
             WHEN 4 THEN 'culture' ELSE 'serendipity' END AS feed, {NOW} - ((doc_id * 31) % 240) * {HOUR} AS published_at,
             ((doc_id * 17 + 3) % 100) / 1e2 AS final_score, CAST(3 + doc_id % 20 AS DOUBLE) AS minutes
      FROM documents WHERE doc_id % 10 >= 8""",
    "opens": """
      SELECT event_id AS open_id, event_id % 1000 AS item_id, 1704067200000 + event_id * 60000 AS opened_at, user_id
      FROM events WHERE event_type IN ('view', 'click')""",
    "feedback": """
      SELECT event_id, event_id % 1000 AS item_id, CASE event_type WHEN 'signup' THEN 'excellent' ELSE 'not_for_me' END AS kind,
             1704067200000 + event_id * 60000 AS created_at
      FROM events WHERE event_type IN ('signup', 'error')""",
    "usage_ledger": f"""
      SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'triage' WHEN 1 THEN 'deep' ELSE 'embedding' END AS stage,
             CASE event_id % 2 WHEN 0 THEN 'cheap' ELSE 'large' END AS model, CAST(100 + event_id % 900 AS BIGINT) AS input_tokens,
             CAST(event_id % 70 AS BIGINT) AS cached_tokens, CAST(10 + event_id % 90 AS BIGINT) AS output_tokens, value / 1e3 AS cost,
             {NOW} - (event_id % 720) * {HOUR} AS created_at
      FROM events WHERE event_type = 'purchase'""",
    "audits": """
      SELECT doc_id AS item_id, CASE doc_id % 2 WHEN 0 THEN 'free_to_triage' ELSE 'triage_to_deep' END AS boundary, source AS source_id,
             CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS band,
             CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'KEEP' WHEN doc_id % 5 = 2 THEN 'UNCERTAIN' ELSE 'DROP' END AS audit_result,
             ((doc_id * 7) % 100) / 1e2 AS semantic_interest, n_chars AS word_count, doc_id % 6 = 0 AS is_serendipity,
             ((doc_id * 13) % 100) / 1e2 AS source_prior, CASE doc_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'essay' ELSE 'unknown' END AS content_type,
             CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 3 = 0 END AS would_have_published, ((doc_id * 29) % 1000) / 1e3 AS audit_score
      FROM documents WHERE doc_id % 4 = 1 OR doc_id % 6 = 0""",
    "entries": """
      SELECT e.event_id AS entry_id, CASE e.event_id % 4 WHEN 0 THEN d.title WHEN 1 THEN regexp_replace(d.title, ' [^ ]*$', '') WHEN 2 THEN 'Reader: ' || d.title ELSE 'Nothing like any title here' END AS title,
             CASE e.event_id % 5 WHEN 0 THEN 'https://r.example.org/open/' || lpad(CAST(d.doc_id AS STRING), 8, '0') WHEN 1 THEN p.url END AS link
      FROM events e JOIN (SELECT doc_id, split_part(split_part(text, chr(10), 1), '. ', 1) AS title FROM documents) d ON d.doc_id = e.event_id % 1000
      LEFT JOIN pages p ON p.page_id = d.doc_id WHERE e.event_type IN ('signup', 'error')""",
    "shelf": f"""
      SELECT d.doc_id AS item_id, n % 4 = 2 AS is_podcast, CASE WHEN n % 4 = 2 THEN 'The Desk ' || CAST(n % 3 AS STRING) || ' Podcast' ELSE 'Desk ' || CAST(n % 3 AS STRING) || ' Daily' END AS source_name,
             split_part(split_part(d.text, chr(10), 1), '. ', 1) AS title, d.text || CASE WHEN d.doc_id % 3 = 0 THEN ' Read it at ' || coalesce(m.url, 'home') ELSE '' END AS description, p.url AS page_url,
             CASE WHEN d.doc_id % 37 = 0 THEN NULL ELSE {NOW} - ((d.doc_id * 7919) % 480) * {HOUR} END AS publication_time, {NOW} - ((d.doc_id * 7919) % 480) * {HOUR} + {HOUR} AS first_seen_at,
             CASE WHEN d.doc_id % 7 = 0 THEN 'https://cdn.example.org/' || CAST(d.doc_id AS STRING) || '.mp3' END AS enclosure_url, CASE WHEN d.doc_id % 14 = 0 THEN 'audio/mpeg' WHEN d.doc_id % 7 = 0 THEN 'image/png' END AS enclosure_type,
             CAST(5 + d.doc_id % 50 AS DOUBLE) AS minutes, d.doc_id % 10 >= 6 AS surfaced
      FROM (SELECT *, CAST(substr(source, 4) AS INT) AS n FROM documents WHERE source IS NOT NULL) d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN pages m ON m.page_id = d.doc_id - d.doc_id % 10 + 8""",
    "page_links": """
      SELECT page_id AS item_id, 0 AS place, split_part(split_part(url, '?', 1), '#', 1) || '/listen.mp3' AS url, CASE page_id % 3 WHEN 0 THEN 'audio_tag' WHEN 1 THEN 'structured_data' ELSE 'embed' END AS kind, CAST(NULL AS STRING) AS title,
             CAST(NULL AS STRING) AS publisher, CAST(page_id % 40 AS DOUBLE) AS minutes FROM pages
      UNION ALL SELECT page_id, 1, 'https://www.youtube.com/embed/' || CAST(page_id AS STRING), 'embed', 'A film', NULL, NULL FROM pages
      UNION ALL SELECT page_id, 2, split_part(split_part(url, '?', 1), '#', 1) || '/transcript', 'structured_data', NULL, 'Desk', NULL FROM pages""",
    "declared": """
      SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN ((doc_id * 32452843 + 11) % 1000) / 1e3 END AS a, CASE WHEN doc_id % 3 = 0 THEN ((doc_id * 49979687 + 5) % 1000) / 1e3 END AS b, CASE WHEN doc_id % 5 > 0 THEN ((doc_id * 67867967) % 1000) / 1e3 END AS c FROM documents""",
    "vectors": "SELECT vec_id AS item_id, embedding, label FROM embeddings",
    "anchors": """
      SELECT v.label AS anchor_id, v.embedding AS anchor, v.label >= 3 AS avoid
      FROM embeddings v JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings WHERE label <= 3 GROUP BY label) m ON m.vec_id = v.vec_id""",
}

#: WITH clause naming every view.
WITH = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in _VIEWS.items())


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the input tables under their own names."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One funnel table."""
    register(spark, sf_dir)
    return spark.sql(_VIEWS[name])
