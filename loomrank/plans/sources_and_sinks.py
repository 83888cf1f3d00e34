"""Queries of parsers, renderers and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.sources import adapters, feeds, sinks
from loomrank.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]


_PICTURED = """
      SELECT page_id, replace(html, '<article>', '<article>' || '<img src="https://i.example.org/' || CAST(page_id AS STRING) || '.jpg" alt="One" width=640 height="480"><IMG class=x data-src=' || chr(39) || 'http://i.example.org/lazy.png' || chr(39) || '><img src="/relative.png">'
        || CASE page_id % 4 WHEN 0 THEN '<img src="https://i.example.org/small.gif" width="32">' WHEN 1 THEN '<img src="https://i.example.org/pixel.gif"><img alt="big" srcset="https://i.example.org/a.jpg 1x, https://i.example.org/b.jpg 2x">'
           WHEN 2 THEN '<img src="https://i.example.org/site-logo.png"><img src="https://i.example.org/logos.png" height="33">' ELSE '<img src="https://i.example.org/' || CAST(page_id AS STRING) || '.jpg" alt="again">' END) AS html FROM pages"""
_PATHS = r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages"
_ROBOTS = f"""
      SELECT DISTINCT host, pattern, allow, kind FROM (SELECT host, length(host) % 4 AS kind FROM ({_PATHS}) p) h JOIN
        (SELECT 0 AS k, '/en/' AS pattern, false AS allow UNION ALL SELECT 0, '/en/*1', true UNION ALL SELECT 0, '/fr/*.html', false UNION ALL SELECT 1, '/', false UNION ALL SELECT 1, '/*/*$', true UNION ALL SELECT 1, '/*.html$', false
         UNION ALL SELECT 2, '', false UNION ALL SELECT 2, '/de/', false UNION ALL SELECT 2, '/de/', true) r ON r.k = h.kind"""


def _feed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RSS document per source from its ten newest items."""
    items = adapters.view(spark, sf_dir, "items").select(F.col("source_id").alias("feed"), "item_id", "title", F.concat(F.lit("https://example.org/"), "item_id").alias("url"), F.col("first_seen_at").alias("published_at"))
    return sinks.documents(items, "rss", 10).select(F.col("feed").alias("source_id"), "body")


def src3_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_items(_feed_docs(spark, sf_dir)).select("source_id", F.col("guid").cast("long").alias("item_id"), "link")


def src4_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _feed_docs(spark, sf_dir).withColumn("body", F.expr("substring(body, 1, length(body) - 60)"))
    return feeds.feed_items(cut).groupBy("source_id").agg(F.count("*").alias("n"))


def src7_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of the pages, which get some of all kinds, and of small and tracking ones."""
    adapters.register(spark, sf_dir)
    return (spark.sql(_PICTURED).select("page_id", F.posexplode(feeds.images(F.col("html"))).alias("place", "i"))
            .select("page_id", "place", "i.*"))


def src14_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of each page; where the page has too little, what the feed said."""
    adapters.register(spark, sf_dir)
    d = spark.sql("SELECT p.page_id, CASE WHEN p.page_id % 3 = 0 THEN regexp_replace(p.html, '<article>', '<article>Hm.</article><div>') ELSE p.html END AS html, d.text FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id + 1 AND p.page_id % 2 = 0")
    return d.select("page_id", feeds.readable(F.col("html"), F.col("text")).alias("r")).select("page_id", "r.method", F.when(F.col("r.method") == "rss", F.col("r.text")).alias("text"))


def src14_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", feeds.page_title(F.col("html")).alias("title"), F.length(feeds.article(F.col("html"))).alias("n"))


def src15_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May a page be fetched, by its host's own rules; hosts differ in what their robots files say."""
    adapters.register(spark, sf_dir)
    return feeds.robots_allowed(spark.sql(f"SELECT host, pattern, allow FROM ({_ROBOTS})"), spark.sql(f"SELECT DISTINCT host, path FROM ({_PATHS})"))


def n2_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("Sure! ```json\n"), "props", F.lit("\n``` done")).alias("answer"))
    return e.select("event_id", feeds.json_object(F.col("answer")).alias("props"))


def n7_accessible(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.when(F.col("page_id") % 2 == 0, '{"@graph":[{"@type":"NewsArticle","isAccessibleForFree":"False"},{"@type":"WebPage","isAccessibleForFree":true}]}').otherwise('{"a":[{"isAccessibleForFree":true}]}').alias("ld"))
    return p.select("page_id", feeds.accessible(F.col("ld")).alias("free"))


def u4_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    return p.select("page_id", feeds.absolute(F.lit("https://example.org/a/b"), F.concat(F.lit("../c/"), "page_id")).alias("url"))


def n12_batch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output lines: ill-formed ones are kept with their error."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_id") % 5 == 0, "{oops").otherwise(F.col("props")).alias("line"))
    return e.select("event_id", F.coalesce(F.from_json("line", "k long").getField("k"), F.lit(-1).cast("long")).alias("k"), F.try_parse_json("line").isNull().alias("failed"))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = adapters.view(spark, sf_dir, "published"), adapters.view(spark, sf_dir, "items").select("item_id", "title")
    return p.join(i, "item_id").withColumn("url", F.concat(F.lit("https://example.org/?a=1&b="), "item_id"))


def _docs(kind: str) -> Query:
    return lambda spark, sf_dir: sinks.documents(_published(spark, sf_dir), kind)


def k6_push_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed documents only: the former state lacks one feed and has an old hash for another."""
    docs = sinks.documents(_published(spark, sf_dir), "rss").select(F.concat(F.lit("rss:"), "feed").alias("key"), F.col("body").alias("value"))
    before = docs.where("key <> 'rss:games'").select("key", F.when(F.col("key") == "rss:culture", "old").otherwise(F.sha2("value", 256)).alias("hash"))
    return sinks.changed(docs, before).select("key")


def k9_weights_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.view(spark, sf_dir, "sources")
    return s.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("source_id", F.round("quality_prior", 6).alias("value")))), lambda x: x)).alias("snapshot"))


def _pulled(spark: SparkSession, sf_dir: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    from loomrank.plans.shared import shared_dir

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(f"{base}/in")
    stream = ev.open_events(spark, f"{base}/in", schema).where("event_type IN ('view', 'click')").withColumn("item_id", F.col("event_id") % 1000)
    q = ev.pull(shape(stream), f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def st1_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pulled(spark, sf_dir, lambda s: s.select("event_id", "item_id", "user_id"))


def st2_known_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"))
    return _pulled(spark, sf_dir, lambda s: ev.known_only(s, items).select("event_id", "item_id"))


def st3_once_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pulled(spark, sf_dir, lambda s: ev.once_a_day(s, late="40 days").select("item_id", "user_id", F.col("day").cast("date").cast("string").alias("day")))


def st7_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("owner"), F.lit("hash").alias("model"), "text")
    stored = d.where("owner % 3 <> 0").select("owner", "model", F.substring(F.sha2("text", 256), 1, 12).alias("hash"))
    return ev.unchanged_skipped(d, stored).select("owner", "hash")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    src3_feed_items, src4_salvage, src7_images, src14_articles, src14_fallback, src15_robots, n2_json_object, n7_accessible, u4_resolve, n12_batch_lines, k6_push_set, k9_weights_snapshot,
    st1_pull, st2_known_only, st3_once_a_day, st7_unchanged)} | {"k1_atom": _docs("atom"), "k2_rss": _docs("rss"), "k3_json_feed": _docs("json")}

_ESC = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')"""
_TOP = """(SELECT p.feed, p.item_id, i.title, p.published_at, 'https://example.org/?a=1&b=' || p.item_id AS url, row_number() OVER (PARTITION BY p.feed ORDER BY p.published_at DESC, p.item_id) AS place
    FROM published p JOIN items i ON i.item_id = p.item_id) WHERE place <= 60"""
ORACLE: dict[str, str] = {
    "src3_feed_items": "SELECT source_id, item_id, 'https://example.org/' || item_id AS link FROM (SELECT source_id, item_id, row_number() OVER (PARTITION BY source_id ORDER BY first_seen_at DESC, item_id) AS rn FROM items) WHERE rn <= 10",
    "src4_salvage": "SELECT source_id, least(10, count(*)) - 1 AS n FROM items GROUP BY source_id",
    "src7_images": """
    SELECT page_id, 0 AS place, 'https://i.example.org/' || page_id || '.jpg' AS url, 'One' AS alt, 640e0 AS width, 480e0 AS height FROM pages WHERE contains(html, '<article>') UNION ALL SELECT page_id, 1, 'http://i.example.org/lazy.png', NULL, NULL, NULL FROM pages WHERE contains(html, '<article>')
    UNION ALL SELECT page_id, 2, 'https://i.example.org/b.jpg', 'big', NULL, NULL FROM pages WHERE page_id % 4 = 1 AND contains(html, '<article>') UNION ALL SELECT page_id, 2, 'https://i.example.org/logos.png', NULL, NULL, 33e0 FROM pages WHERE page_id % 4 = 2 AND contains(html, '<article>')""",
    "src14_fallback": """
    SELECT p.page_id, CASE WHEN p.page_id % 3 > 0 AND long THEN 'page' WHEN length(trim(d.text)) > n THEN 'rss' ELSE 'page_short' END AS method, CASE WHEN NOT (p.page_id % 3 > 0 AND long) AND length(trim(d.text)) > n THEN trim(d.text) END AS text
    FROM (SELECT *, n >= 200 AS long FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 3 ELSE length(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) END AS n FROM pages)) p
    LEFT JOIN documents d ON d.doc_id = p.page_id + 1 AND p.page_id % 2 = 0""",
    "src15_robots": f"""
    SELECT host, path, coalesce(allow, true) AS allowed FROM (SELECT p.host, p.path, r.allow, row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.pattern) DESC, r.allow DESC) AS rn FROM (SELECT DISTINCT host, path FROM ({_PATHS})) p
      LEFT JOIN (SELECT DISTINCT host, pattern, allow FROM ({_ROBOTS}) WHERE pattern <> '') r ON r.host = p.host AND regexp_matches(p.path, CASE r.pattern WHEN '/en/*1' THEN '^/en/.*1' WHEN '/fr/*.html' THEN '^/fr/.*[.]html' WHEN '/*/*$' THEN '^/.*/.*$' WHEN '/*.html$' THEN '^/.*[.]html$' ELSE '^' || r.pattern END)) WHERE rn = 1""",
    "n2_json_object": "SELECT event_id, props FROM events",
    "n7_accessible": "SELECT page_id, page_id % 2 <> 0 AS free FROM pages",
    "u4_resolve": "SELECT page_id, 'https://example.org/c/' || page_id AS url FROM pages",
    "n12_batch_lines": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN json_extract(props, '$.k')::BIGINT ELSE -1 END AS k, event_id % 5 = 0 AS failed FROM events",
    "k2_rss": f"""SELECT feed, '<rss version="2.0"><channel><title>' || feed || '</title>' || string_agg('<item><title>' || {_ESC.format('title')} || '</title><link>' || {_ESC.format('url')} || '</link><guid>' || item_id ||
        '</guid><pubDate>' || strftime(make_timestamp(published_at * 1000), '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>', '' ORDER BY place) || '</channel></rss>' AS body FROM {_TOP} GROUP BY feed""",
    "k1_atom": f"""SELECT feed, '<feed xmlns="http://www.w3.org/2005/Atom"><title>' || feed || '</title>' || string_agg('<entry><title>' || {_ESC.format('title')} || '</title><link href="' || {_ESC.format('url')} || '"/><id>' || item_id ||
        '</id><updated>' || strftime(make_timestamp(published_at * 1000), '%Y-%m-%dT%H:%M:%SZ') || '</updated></entry>', '' ORDER BY place) || '</feed>' AS body FROM {_TOP} GROUP BY feed""",
    "k6_push_set": "SELECT 'rss:' || feed AS key FROM (SELECT DISTINCT feed FROM published) WHERE feed IN ('games', 'culture')",
    "st1_pull": "SELECT event_id, event_id % 1000 AS item_id, user_id FROM events WHERE event_type IN ('view', 'click')",
    "st2_known_only": "SELECT event_id, event_id % 1000 AS item_id FROM events WHERE event_type IN ('view', 'click') AND event_id % 1000 IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)",
    "st3_once_a_day": "SELECT DISTINCT event_id % 1000 AS item_id, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type IN ('view', 'click')",
    "st7_unchanged": "SELECT doc_id AS owner, left(sha256(text), 12) AS hash FROM documents WHERE doc_id % 3 = 0",
}
