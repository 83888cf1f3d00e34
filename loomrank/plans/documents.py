"""Queries of feed documents, JSON-LD, addresses, messages, entries, static files and the journal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.functions import net
from loomrank.functions import text as X
from loomrank.operators import profiles
from loomrank.plans import sources_and_sinks
from loomrank.plans.shared import shared_dir
from loomrank.sources import adapters, export, jsonld, messages, sinks, xmlfeeds
from loomrank.sources.adapters import WITH
from loomrank.streaming.journal import Journal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"{WITH}\n{sql}"
        return f

    return add


def _feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS and Atom documents of up to 50 items of a source, written in the ways feeds differ; a third of them breaks off inside its last item."""
    def tag(name, value, more=""):
        return F.concat(F.lit(f"<{name}{more}>"), value, F.lit(f"</{name}>"))

    def void(xml):
        """A literal with {u} for the url and {n} for the id."""
        return F.replace(F.replace(F.lit(xml), F.lit("{u}"), url), F.lit("{n}"), n)

    items = adapters.view(spark, sf_dir, "items").where("source_id IS NOT NULL").select("source_id", "item_id", "title", F.floor(F.col("item_id") / 50).alias("part"))
    n, url = F.col("item_id").cast("string"), F.concat(F.lit("https://example.org/"), F.col("item_id").cast("string"))
    title, v = X.escape_xml(F.col("title")), F.col("item_id") % 4
    rss = (F.when(v == 0, F.concat(tag("title", title), tag("link", url), tag("guid", n, ' isPermaLink="false"'), tag("description", F.concat(F.lit("<![CDATA[<p>"), n, F.lit("</p>]]>"))), tag("pubDate", F.lit("Wed, 19 Aug 2026 12:50:00 +0000")),
                                   tag("author", F.concat(F.lit("m@x.org (Ann "), n, F.lit(")"))), void('<enclosure url="{u}.mp3" type="audio/mpeg" length="{n}"/>')))
           .when(v == 1, F.concat(tag("itunes:title", title), tag("guid", url), tag("itunes:summary", n), tag("dc:date", F.lit("2026-08-19")), tag("dc:creator", F.concat(F.lit("Bo "), n)), void('<media:content url="{u}.mp4" type="video/mp4"/>')))
           .when(v == 2, F.concat(tag("title", title), tag("link", url), tag("content:encoded", n), tag("summary", F.lit("of two")), tag("date", F.lit("2026")), tag("itunes:author", n), void('<media:content url="{u}.png" type="image/png"/>')))
           .otherwise(F.concat(tag("title", title), tag("feedburner:origLink", url), F.lit("<description></description>"), tag("author", F.concat(F.lit("x@y.org Cy "), n)))))
    atom = F.concat(tag("title", title), tag("id", n), tag("updated", F.lit("2026-02-02T00:00:00Z")), tag("author", tag("name", F.concat(F.lit("Di &amp; "), n))),
                    F.when(v == 0, void('<link rel="self" href="{u}/self"/><link href="{u}"/>')).when(v == 1, void('<link rel="enclosure" href="{u}.mp3" type="audio/mpeg" length="{n}"/><link rel="alternate" type="text/html" href="{u}"/>'))
                    .when(v == 2, void('<link rel="related" href="{u}"/><link rel="enclosure" href="{u}.m4a"/>')).otherwise(void('<link rel="alternate" type="application/json" href="{u}"/>')), tag("summary", n))
    is_rss = F.substring("source_id", 4, 9).cast("int") % 2 == 0
    entry = F.when(is_rss, tag("item", rss)).otherwise(tag("entry", atom))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", entry.alias("e")))), lambda x: x["e"]), "\n")
    docs = items.groupBy("source_id", "part").agg(body.alias("inner")).withColumn("body", F.when(is_rss, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>F</title>'), "inner", F.lit("</channel></rss>")))
                                                                                  .otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>'), "inner", F.lit("</feed>"))))
    return docs.select("source_id", F.when(F.col("part") % 3 == 0, F.substring("body", F.lit(1), F.length("body") - 30)).otherwise(F.col("body")).alias("body"))


# what the documents were made from; the last item of a document that breaks off is gone
_FED = r"""
    , fed AS (SELECT * FROM (SELECT source_id, item_id, item_id % 4 AS v, CAST(substr(source_id, 4) AS INT) % 2 = 0 AS rss, item_id // 50 AS part, 'https://example.org/' || item_id AS u, item_id::VARCHAR AS n,
        trim(regexp_replace(regexp_replace(title, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\s+', ' ', 'g')) AS title, row_number() OVER (PARTITION BY source_id, item_id // 50 ORDER BY item_id DESC) AS back
      FROM items WHERE source_id IS NOT NULL) WHERE part % 3 <> 0 OR back > 1)"""


@query("src5_entry_fields", f"""{_FED}
    SELECT source_id, CASE WHEN rss AND v = 1 THEN u WHEN rss AND v > 1 THEN NULL ELSE n END AS guid, title, u AS link, CASE WHEN NOT rss THEN n WHEN v = 0 THEN '<p>' || n || '</p>' WHEN v = 1 THEN n WHEN v = 2 THEN 'of two' END AS summary, CASE WHEN rss AND v = 2 THEN n END AS content,
      CASE WHEN NOT rss THEN '2026-02-02T00:00:00Z' WHEN v = 0 THEN 'Wed, 19 Aug 2026 12:50:00 +0000' WHEN v = 1 THEN '2026-08-19' WHEN v = 2 THEN '2026' END AS published,
      CASE WHEN NOT rss THEN 'Di & ' || n WHEN v = 0 THEN 'Ann ' || n WHEN v = 1 THEN 'Bo ' || n WHEN v = 3 THEN 'Cy ' || n END AS author FROM fed""")
def src5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's fields, whatever its feed calls them."""
    return xmlfeeds.items(_feed_documents(spark, sf_dir)).select("source_id", "guid", "title", "link", "summary", "content", "published", "author")


@query("src6_enclosures", f"""{_FED}
    SELECT u AS link, CASE WHEN rss AND v = 0 OR NOT rss AND v = 1 THEN u || '.mp3' WHEN rss THEN u || '.mp4' ELSE u || '.m4a' END AS url,
      CASE WHEN rss AND v = 0 OR NOT rss AND v = 1 THEN 'audio/mpeg' WHEN rss THEN 'video/mp4' END AS type, CASE WHEN rss AND v = 0 OR NOT rss AND v = 1 THEN item_id END AS length
    FROM fed WHERE rss AND v < 2 OR NOT rss AND v IN (1, 2)""")
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attached media: by element, by link, by media content that can be heard or seen."""
    return xmlfeeds.items(_feed_documents(spark, sf_dir)).where("enclosure IS NOT NULL").select("link", "enclosure.*")


_OUTBOUND = """
      SELECT page_id, CASE page_id % 8 WHEN 1 THEN 'http://' || CAST(page_id * 37 % 256 AS STRING) || '.' || CAST(page_id * 91 % 256 AS STRING) || '.' || CAST(page_id * 13 % 256 AS STRING) || '.' || CAST(page_id % 256 AS STRING) || '/x'
               WHEN 2 THEN 'http://' || CAST(page_id * 102334841 % 4294967296 AS STRING) || ':8080/' WHEN 3 THEN replace(url, '://', '://user:pw@') WHEN 4 THEN 'ftp://files.example.org/a'
               WHEN 5 THEN 'https://[' || CASE page_id % 7 WHEN 0 THEN '2001:db8::1' WHEN 1 THEN 'fd12::' WHEN 2 THEN 'fe80::1' WHEN 3 THEN '::1' WHEN 4 THEN '::ffff:10.0.0.1' WHEN 5 THEN '::ffff:8.8.8.8' ELSE '2606:4700::1111' END || ']/'
               WHEN 6 THEN 'no url at all' ELSE url END AS url FROM pages"""


@query("src18_outbound", f"""
    , o AS (SELECT *, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h FROM ({_OUTBOUND})),
    a AS (SELECT *, CASE WHEN page_id % 8 = 1 THEN (((page_id * 37 % 256) * 256 + page_id * 91 % 256) * 256 + page_id * 13 % 256) * 256 + page_id % 256 WHEN page_id % 8 = 2 THEN page_id * 102334841 % 4294967296 END AS number FROM o)
    SELECT page_id, CASE page_id % 8 WHEN 3 THEN 'blocked URL containing credentials' WHEN 4 THEN 'blocked URL protocol: ftp:' WHEN 6 THEN 'invalid URL' WHEN 7 THEN 'hostname did not resolve: ' || h
      WHEN 0 THEN CASE WHEN page_id % 24 = 0 THEN 'blocked non-public address for ' || h || ': 10.0.0.5' ELSE 'ok' END
      WHEN 5 THEN CASE WHEN page_id % 7 < 5 THEN 'blocked non-public address for ' || trim(h, '[]') || ': ' || trim(h, '[]') ELSE 'ok' END
      ELSE CASE WHEN {" OR ".join(f"number BETWEEN {lo} AND {hi}" for lo, hi in (net._span4(*b) for b in net.PRIVATE_V4))} THEN 'blocked non-public address for ' || split_part(h, ':', 1) || ': ' || split_part(h, ':', 1) ELSE 'ok' END END AS verdict FROM a""")
def src18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which urls may be fetched, given what names resolve to."""
    adapters.register(spark, sf_dir)
    public, private = F.lit("93.184.216.34"), F.lit("10.0.0.5")
    resolved = F.when(F.col("page_id") % 24 == 0, F.array(public, private)).when(F.col("page_id") % 8 == 0, F.array(public))
    return spark.sql(_OUTBOUND).select("page_id", net.outbound_verdict(F.col("url"), resolved).alias("verdict"))


_LINKED = """
      SELECT page_id, replace(html, '</head>', '<script type="application/ld+json">' || CASE page_id % 4
        WHEN 0 THEN '{"@graph":[{"@type":"NewsArticle","url":"' || url || '","publisher":{"name":"Desk ' || CAST(page_id % 7 AS STRING) || '"},"mainEntity":{"@type":"Person","hasPart":[{"@type":"Clip"},{"@type":"Clip","other":{"@type":"Not followed"},"mainEntity":{"@type":"Deep","hasPart":{"@type":"Too deep"}}}]}},[{"@type":"Nested"}],null,3]}'
        WHEN 1 THEN '[{"@type":"WebPage","author":"Ann"},{"@type":"ItemList","partOfSeries":{"name":"Series"},"itemListElement":[{"@type":"ListItem"},"text"],"associatedMedia":{"@type":"AudioObject"}}]'
        WHEN 2 THEN '{"@type":"Broken' ELSE '"a string"' END || '</script></head>') AS html FROM pages"""


@query("n8_jsonld_flatten", f"""
    , l AS (SELECT page_id, regexp_extract(html, '<script type="application/ld.json">(.*?)</script>', 1) AS ld FROM ({_LINKED})),
    f AS (WITH RECURSIVE r AS (SELECT page_id, 0 AS depth, ld::JSON AS v FROM l WHERE json_valid(ld)
      UNION ALL SELECT page_id, depth + 1, unnest(CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN list_filter([{", ".join(f"json_extract(v, '$." + chr(34) + k + chr(34) + "')" for k in jsonld.NESTING)}], lambda x: x IS NOT NULL) ELSE [] END) FROM r WHERE depth < 6) SELECT * FROM r)
    SELECT page_id, depth, json_extract_string(v, '$."@type"') AS type, CASE WHEN json_type(p) = 'OBJECT' THEN json_extract_string(p, '$.name') WHEN json_type(p) = 'VARCHAR' THEN json_extract_string(p, '$') END AS publisher, json_extract_string(v, '$.url') AS url
    FROM (SELECT *, coalesce(json_extract(v, '$.publisher'), json_extract(v, '$.partOfSeries'), json_extract(v, '$.author')) AS p FROM f WHERE json_type(v) = 'OBJECT')""")
def n8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects of the pages' JSON-LD, with type and publisher."""
    adapters.register(spark, sf_dir)
    found = spark.sql(_LINKED).select("page_id", F.explode(jsonld.scripts(F.col("html"))).alias("raw")).select("page_id", F.try_parse_json("raw").alias("v"))
    node = F.col("node")
    return jsonld.flatten(found, "page_id", "v").select("page_id", "depth", jsonld.text_of(node, "$['@type']").alias("type"), jsonld.publisher(node).alias("publisher"), jsonld.text_of(node, "$.url").alias("url"))


_PARAGRAPHS = "replace(text, chr(10), chr(10) || chr(10))"


def _excerpt_sql(most: int) -> str:
    """Columns text, excerpted, omitted of a relation with column body."""
    room = most - len(X.OMITTED)
    head = int(room * .6)
    tail = room - head
    mark = "'" + X.OMITTED.replace("\n", "' || chr(10) || '") + "'"
    return f"""(SELECT * EXCLUDE (hd, tl, b, e), CASE WHEN length(body) > {most} THEN b || {mark} || e ELSE body END AS text, length(body) > {most} AS excerpted, CASE WHEN length(body) > {most} THEN length(body) - length(b) - length(e) ELSE 0 END AS omitted FROM
      (SELECT *, CASE WHEN strpos(reverse(hd), chr(10) || chr(10)) > 0 AND length(hd) - strpos(reverse(hd), chr(10) || chr(10)) - 1 > {head} * 0.6 THEN substr(hd, 1, length(hd) - strpos(reverse(hd), chr(10) || chr(10)) - 1) ELSE hd END AS b,
        CASE WHEN strpos(tl, chr(10) || chr(10)) > 0 AND strpos(tl, chr(10) || chr(10)) - 1 < {tail} * 0.4 THEN substr(tl, strpos(tl, chr(10) || chr(10)) + 2) ELSE tl END AS e
       FROM (SELECT *, substr(body, 1, {head}) AS hd, right(body, {tail}) AS tl FROM {{rel}})))"""


@query("x10_structural_excerpt", f"SELECT doc_id, text, excerpted, omitted::INT AS omitted FROM {_excerpt_sql(600).format(rel=f'(SELECT doc_id, coalesce({_PARAGRAPHS}, $$$$) AS body FROM documents)')}")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and closing of long texts, cut at paragraphs."""
    adapters.register(spark, sf_dir)
    docs = spark.sql(f"SELECT doc_id, {_PARAGRAPHS} AS body FROM documents")
    return docs.select("doc_id", X.structural_excerpt(F.col("body"), 600).alias("x")).select("doc_id", "x.*")


_DEEP = """
      SELECT i.item_id, i.cluster_id, 'Desk ' || i.source_id AS source_name, CASE WHEN i.item_id % 9 = 0 THEN 'product' ELSE 'article' END AS kind, CASE WHEN i.item_id % 5 = 0 THEN 'Ann' END AS author, i.title, CASE WHEN i.item_id % 6 = 0 THEN 'Sub' END AS subtitle,
             i.publication_time AS at, CASE WHEN i.item_id % 2 = 0 THEN 'https://example.org/' || CAST(i.item_id AS STRING) END AS url, i.category, replace(i.summary, chr(10), chr(10) || chr(10)) AS body, i.title AS summary, i.item_id % 2 = 0 AS extracted,
             i.source_id, CASE WHEN i.item_id % 4 = 0 THEN 'gist' END AS gist, i.status = 'published' AS shown
      FROM items i WHERE i.status IN ('deep_evaluated', 'published')"""
_NL = "chr(10)"


@query("r43_deep_message", f"""
    , m AS (SELECT * REPLACE (trim(body) AS body) FROM ({_DEEP})),
    s AS (SELECT item_id, string_agg('- ' || coalesce(source_id, '') || ': ' || title || CASE WHEN gist IS NOT NULL THEN ' — ' || gist ELSE '' END || CASE WHEN shown THEN ' [already shown to the reader]' ELSE '' END, {_NL} ORDER BY place) AS told FROM (
      SELECT a.item_id, b.source_id, b.title, b.gist, b.shown, row_number() OVER (PARTITION BY a.item_id ORDER BY b.shown DESC, b.item_id) AS place FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.item_id <> b.item_id) WHERE place <= 6 GROUP BY item_id),
    x AS (SELECT * FROM {_excerpt_sql(700).format(rel="m")}),
    t AS (SELECT x.item_id, 'Source: ' || coalesce(source_name, '') || CASE WHEN kind = 'product' THEN {_NL} || 'Item type: product discovery card' ELSE '' END || coalesce({_NL} || 'Author: ' || author, '') || {_NL} || 'Title: ' || coalesce(title, '') || coalesce({_NL} || 'Subtitle: ' || subtitle, '')
      || coalesce({_NL} || 'Published: ' || strftime(make_timestamp(x.at * 1000), '%Y-%m-%d'), '') || coalesce({_NL} || 'URL: ' || url, '') || {_NL} || 'Suggested category: ' || category || coalesce({_NL} || {_NL} || 'Other coverage of this same story:' || {_NL} || told, '') || {_NL} || {_NL} ||
      CASE WHEN length(b) > 200 THEN 'Article length: ~' || len(regexp_split_to_array(b, '\\s+')) || ' words.' || {_NL} || CASE WHEN NOT extracted THEN '--- Article text (RSS content only; the full page was not available) ---' WHEN excerpted THEN '--- Article text (opening and closing; the middle is omitted for length) ---'
        ELSE '--- Article text ---' END || {_NL} || text || CASE WHEN excerpted THEN {_NL} || {_NL} || '(This is an excerpt of a ~' || len(regexp_split_to_array(b, '\\s+')) || '-word article; ' || omitted || ' characters from the middle are not shown. Judge it as the long piece it is.)' ELSE '' END
      ELSE '--- Only the RSS summary is available for this item ---' || {_NL} || coalesce(summary, '(no summary)') || {_NL} || {_NL} || '{messages.SHORT_NOTE}' END AS msg FROM (SELECT *, body AS b FROM x) x LEFT JOIN s ON s.item_id = x.item_id)
    SELECT item_id, '--- BEGIN UNTRUSTED ARTICLE DATA (' || strlen(msg) || ' BYTES) ---' || {_NL} || msg || {_NL} || '--- END UNTRUSTED ARTICLE DATA ---' AS message FROM t""")
def r43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deep stage's message of each evaluated item, with up to six siblings of its cluster."""
    adapters.register(spark, sf_dir)
    deep = spark.sql(f"{WITH} {_DEEP}").withColumn("categories", F.array("category"))
    # seven of a cluster hold six siblings of any member
    first = Window.partitionBy("cluster_id").orderBy(F.desc("shown"), "item_id")
    row = F.struct((~F.col("shown")).alias("later"), "item_id", "source_id", "title", "gist", "shown")
    known = deep.withColumn("place", F.row_number().over(first)).where("place <= 7").groupBy(F.col("cluster_id").alias("of")).agg(F.array_sort(F.collect_list(row)).alias("near"))
    siblings = F.slice(F.filter("near", lambda s: s["item_id"] != F.col("item_id")), 1, 6)
    return deep.join(known, F.col("cluster_id") == F.col("of"), "left").select("item_id", messages.deep_message(siblings, 700).alias("message"))


_ENTRY = """
      SELECT s.item_id, s.source_name, CASE WHEN s.item_id % 5 = 0 THEN 'Ann & Co' END AS author, s.minutes * 9 AS minutes, CASE WHEN s.item_id % 7 = 0 THEN 'product' ELSE 'article' END AS kind, CASE WHEN s.item_id % 3 = 0 THEN 'Why "not"?' END AS why,
             CASE WHEN s.item_id % 2 = 0 THEN s.title END AS summary, CASE WHEN s.item_id % 4 = 0 THEN s.page_url ELSE 'https://t.example.org/open/' || CAST(s.item_id AS STRING) END AS link, s.page_url AS original_url,
             CASE s.item_id % 3 WHEN 0 THEN 'https://i.example.org/logo.png' WHEN 1 THEN 'https://i.example.org/' || CAST(s.item_id AS STRING) || '.jpg' END AS lead_image FROM shelf s WHERE s.page_url IS NOT NULL"""
_E = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_CLEAN = _E.format(r"regexp_replace({}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')")


@query("k4_item_html", rf"""
    , w AS (SELECT *, floor(minutes + 0.5)::BIGINT AS mm, trim(regexp_replace(summary, '\s+', ' ', 'g')) AS sm FROM ({_ENTRY})),
    h AS (SELECT *, CASE WHEN mm < 60 THEN mm || ' min' ELSE (mm // 60) || 'h' || CASE WHEN mm % 60 > 0 THEN ' ' || (mm % 60) || 'm' ELSE '' END END AS long, substr(sm, 1, 400) AS cut FROM w),
    l AS (SELECT item_id, string_agg('<p style="{messages.LINE}"><a href="' || {_E.format("url")} || '"><strong>' || CASE format_type WHEN 'video_version' THEN '📺 Watch instead' WHEN 'transcript' THEN '📄 Transcript' ELSE '🎧 Listen instead' END ||
        CASE WHEN minutes IS NULL THEN '' ELSE ' — ' || minutes::INT || ' min' END || '</strong></a>' || CASE WHEN format_type = 'audio_version' THEN ' &nbsp;<a href="https://s.example.org/' || item_id || '">Find on Spotify</a>' ELSE '' END || '</p>', chr(10) ORDER BY place) AS others
      FROM (SELECT *, CASE place WHEN 0 THEN 'audio_version' WHEN 1 THEN 'video_version' ELSE 'transcript' END AS format_type FROM page_links) GROUP BY item_id)
    SELECT h.item_id, '<p style="color:#666;font-size:0.9em;margin:0 0 1em 0">' || {_E.format("source_name || coalesce(' · ' || author, '') || ' · ' || long")} || '</p>' || CASE WHEN kind = 'product' THEN chr(10) || '<p style="{messages.LINE}"><strong>Product discovery</strong></p>' ELSE '' END ||
      CASE WHEN h.item_id % 4 = 1 THEN chr(10) || '<figure style="{messages.LINE}"><img src="https://p.example.org/' || h.item_id || '.png" alt="A &lt;cap&gt;" style="max-width:100%;height:auto"><figcaption style="{messages.GREY}">A &lt;cap&gt;</figcaption></figure>'
        WHEN h.item_id % 3 = 1 THEN chr(10) || '<figure style="{messages.LINE}"><img src="' || lead_image || '" alt="" style="max-width:100%;height:auto"></figure>' ELSE '' END ||
      CASE WHEN why IS NOT NULL THEN chr(10) || '<p style="{messages.LINE}"><strong>Why this surfaced:</strong><br>Why &quot;not&quot;?</p>' ELSE '' END || coalesce(chr(10) || others, '') ||
      CASE WHEN sm <> '' THEN chr(10) || '<p style="{messages.LINE}">' || {_CLEAN.format("CASE WHEN length(sm) <= 400 THEN sm ELSE rtrim(CASE WHEN instr(cut, ' ') > 0 AND 400 - instr(reverse(cut), ' ') > 240 THEN substr(cut, 1, 400 - instr(reverse(cut), ' ')) ELSE cut END) || '…' END")} || '</p>' ELSE '' END ||
      chr(10) || '<p style="margin:0"><a href="' || {_E.format("link")} || '">Original article</a>' || chr(10) || CASE WHEN link <> original_url THEN ' <span style="color:#999;font-size:0.85em">(' || regexp_replace(lower(regexp_extract(original_url, '^https?://([^/?#:]*)', 1)), '^www\.', '') || ')</span>' ELSE '' END || '</p>' AS html
    FROM h LEFT JOIN l ON l.item_id = h.item_id""")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry's html: byline, pictures, reason, other formats, summary, link."""
    adapters.register(spark, sf_dir)
    entries = spark.sql(f"{WITH} {_ENTRY}")
    kinds = F.element_at(F.array(F.lit("audio_version"), F.lit("video_version"), F.lit("transcript")), F.col("place") + 1)
    spotify = F.when(F.col("place") == 0, F.concat(F.lit("https://s.example.org/"), "item_id"))
    other = F.struct("place", kinds.alias("format_type"), "url", "minutes", spotify.alias("spotify_url"))
    links = adapters.view(spark, sf_dir, "page_links").groupBy("item_id").agg(F.array_sort(F.collect_list(other)).alias("others"))
    images = F.when(F.col("item_id") % 4 == 1, F.array(F.struct(F.concat(F.lit("https://p.example.org/"), "item_id", F.lit(".png")).alias("url"), F.lit(None).cast("string").alias("alt"), F.lit("A <cap>").alias("caption"))))
    joined = entries.join(links, "item_id", "left").withColumn("others", F.coalesce("others", F.array().cast("array<struct<place:int,format_type:string,url:string,minutes:double,spotify_url:string>>")))
    return joined.select("item_id", messages.item_html(F.col("others"), images).alias("html"))


@query("k5_static_export", f"""
    SELECT name, strlen(body)::BIGINT AS bytes, sha256(body) AS sha256, true AS intact FROM (SELECT 'feed-' || feed || '.xml' AS name, body FROM ({sources_and_sinks.ORACLE["k1_atom"]}) UNION ALL SELECT 'feed-' || feed || '.rss', body FROM ({sources_and_sinks.ORACLE["k2_rss"]}))""")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feeds as files, written twice: the second export takes the place of the first, which held one file more. Read back and held against the manifest."""
    folder = f"{shared_dir(spark)}/static-{uuid.uuid4().hex}"
    published = sources_and_sinks._published(spark, sf_dir)
    made = [sinks.documents(published, kind).select(F.concat(F.lit("feed-"), "feed", F.lit(f".{end}")).alias("name"), "body") for kind, end in (("atom", "xml"), ("rss", "rss"))]
    docs = made[0].unionByName(made[1])
    export.export_static(docs.unionByName(spark.sql("SELECT 'feed-gone.xml' AS name, 'x' AS body")), folder)
    export.export_static(docs, folder)
    back = export.exported(spark, folder)
    return back.select("name", "bytes", "sha256", F.coalesce((F.sha2("body", 256) == F.col("sha256")) & (F.octet_length("body") == F.col("bytes")), F.lit(False)).alias("intact"))


@query("k10_journal", """
    SELECT kind, status, rows, cost, error FROM (SELECT 'ledger' AS kind, 'ok' AS status, count(*) AS rows, round(sum(cost), 4) AS cost, NULL AS error FROM usage_ledger
      UNION ALL SELECT 'broken', 'failed', NULL, NULL, 'ValueError: no such stage' UNION ALL SELECT 'errors', 'ok', count(*), NULL, NULL FROM conversations WHERE length(text) < 40)""")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three jobs in the journal: one that copies the ledger and counts it on the way, one that fails, one that records errors."""
    folder = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    journal = Journal(spark, folder)
    with journal.job("ledger") as job:
        job.observe(adapters.view(spark, sf_dir, "usage_ledger"), "copied", cost=F.sum("cost")).write.parquet(f"{folder}/ledger")
    try:
        with journal.job("broken"):
            raise ValueError("no such stage")
    except ValueError:
        pass
    with journal.job("errors") as job:
        short = spark.table("conversations").where(F.length("text") < 40).select(F.col("conv_id").cast("string").alias("scope"), F.lit("deep").alias("stage"), F.lit("too short").alias("message"), F.col("text").alias("detail"))
        journal.record_errors(job.observe(short, "found"))
    rows = F.coalesce(F.get_json_object("stats", "$.copied.rows"), F.get_json_object("stats", "$.found.rows")).cast("long")
    return journal.jobs().select("kind", "status", rows.alias("rows"), F.round(F.get_json_object("stats", "$.copied.cost").cast("double"), 4).alias("cost"), "error")


_TURNS = """
      SELECT conv_id, turn, role, 't' || CAST(turn % 6 AS STRING) AS id, trim(substr(replace(text, chr(10), ' '), 1, 18)) AS label, CASE turn % 5 WHEN 0 THEN 'core' WHEN 1 THEN 'unwanted' WHEN 2 THEN 'low' WHEN 3 THEN 'core' ELSE 'very_strong' END AS tier,
             (length(text) % 100) / 1e2 AS confidence, CAST(length(text) % 11 AS DOUBLE) AS priority, turn % 3 = 0 AS conditional, turn % 4 = 1 AS avoiding, CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'unknown' ELSE 'low' END AS tolerance,
             turn % 7 = 3 AS elsewhere, CASE turn % 5 WHEN 0 THEN 'strong_positive' WHEN 1 THEN 'mild_negative' WHEN 2 THEN 'hard_filter' WHEN 3 THEN 'mild_positive' ELSE 'neutral' END AS effect,
             CASE turn % 5 WHEN 0 THEN 'known_favorite' WHEN 1 THEN 'known_dislike' WHEN 2 THEN 'style_reference' WHEN 3 THEN 'noisy_but_useful' ELSE 'heard_of' END AS relationship FROM conversations WHERE text IS NOT NULL"""


@query("r46_profiles", rf"""
    , t AS (SELECT *, CASE WHEN conditional THEN 'when new' END AS cond FROM ({_TURNS})),
    avoided AS (SELECT conv_id, string_agg(id || '=' || text || '/' || strength, ' | ' ORDER BY first) AS avoid_anchors FROM (
      SELECT conv_id, id, min(place) AS first, max_by(text, place) AS text, max_by(strength, place) AS strength FROM (
        SELECT conv_id, turn AS place, id, 'no ' || label AS text, 'strong' AS strength FROM t WHERE avoiding
        UNION ALL SELECT conv_id, 1000000 + turn, id, label || ': ' || role || coalesce('; ' || cond, ''), 'moderate' FROM t WHERE tier = 'unwanted'
        UNION ALL SELECT conv_id, 2000000 + turn, 'source_' || regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), label || ': on ' || role, 'moderate' FROM t WHERE relationship = 'known_dislike') GROUP BY conv_id, id) GROUP BY conv_id)
    SELECT conv_id, trim(regexp_replace('Reads ' || max(CASE WHEN turn = 0 THEN label ELSE '' END) || '  and   more', '\s+', ' ', 'g')) AS about_me,
      coalesce(string_agg(label, ' | ' ORDER BY turn) FILTER (tier = 'core' AND confidence >= 0.55e0), '') AS strong_interests,
      string_agg(id || '=' || (floor((5 + (priority - 5) * confidence) * 100 + 0.5) / 100)::DECIMAL(9,2) || ' ' || replace(tier, '_', ' ') || ' interest. Prefer ' || role || '.' || CASE WHEN avoiding THEN ' Avoid noise, ads.' ELSE '' END || CASE WHEN conditional THEN ' Conditions: when new.' ELSE '' END
        || CASE WHEN turn % 8 = 0 THEN ' Not daily.' WHEN tolerance <> 'unknown' THEN ' Repeat tolerance: ' || tolerance || '.' ELSE '' END || CASE WHEN elsewhere THEN ' Text must clear a higher quality bar because another medium is usually preferred.' ELSE '' END, ' | ' ORDER BY turn) AS topic_priorities,
      coalesce(string_agg(replace(effect, '_positive', '') || ': ' || label || ' — ' || role, ' | ' ORDER BY turn) FILTER (effect LIKE '%positive' AND confidence >= 0.35e0), '') AS positive_traits,
      coalesce(string_agg(CASE effect WHEN 'hard_filter' THEN 'hard filter' ELSE replace(effect, '_negative', '') END || ': ' || label || ' — ' || role, ' | ' ORDER BY turn) FILTER ((effect LIKE '%negative' OR effect = 'hard_filter') AND confidence >= 0.35e0), '') AS negative_traits,
      coalesce(CASE WHEN conv_id % 2 = 0 THEN string_agg('a' || turn || '=' || label, ' | ' ORDER BY turn) FILTER (turn % 2 = 0) ELSE string_agg(id || '=' || label || ': ' || role || coalesce('; ' || cond, ''), ' | ' ORDER BY turn) FILTER (tier NOT IN ('low', 'unwanted')) END, '') AS interest_anchors,
      coalesce(max(avoid_anchors), '') AS avoid_anchors,
      coalesce(string_agg(label || ':' || CASE relationship WHEN 'known_favorite' THEN 'known_favorite/direct_follow' WHEN 'known_dislike' THEN 'avoid/direct_follow' ELSE 'exploratory/discovery_only' END, ' | ' ORDER BY turn) FILTER (relationship IN ('known_favorite', 'known_dislike', 'noisy_but_useful')), '') AS source_preferences,
      coalesce(string_agg(label, ' | ' ORDER BY turn) FILTER (relationship = 'style_reference'), '') AS style_references
    FROM t LEFT JOIN avoided USING (conv_id) GROUP BY conv_id""")
def r46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each conversation, read as what a reader says of their interests, turn by turn."""
    adapters.register(spark, sf_dir)
    c, none = F.col, F.array().cast("array<string>")
    own = F.array("role")
    fits = lambda flag, *values: F.when(c(flag), F.array(*map(F.lit, values))).otherwise(none)
    interest = F.struct("id", "label", "tier", "confidence", "priority", own.alias("preferred_coverage"), fits("avoiding", "noise", "ads").alias("avoid_coverage"), fits("conditional", "when new").alias("conditions"),
                        F.when(c("turn") % 8 == 0, "Not daily.").alias("saturation_guidance"), c("tolerance").alias("repeat_tolerance"), F.when(c("elsewhere"), "stronger_elsewhere").alias("medium_fit"))
    row = F.struct("turn", interest.alias("interest"), F.struct(c("label").alias("signal"), "effect", c("role").alias("why"), "confidence").alias("signal"), F.struct(F.concat(F.lit("a"), "turn").alias("id"), c("label").alias("description")).alias("anchor"),
                   F.struct("id", F.concat(F.lit("no "), "label").alias("description"), F.lit("strong").alias("strength")).alias("avoid"), c("avoiding"),
                   F.struct(c("label").alias("name"), "relationship", F.concat(F.lit("on "), "role").alias("scope"), c("role").alias("reason"), "confidence").alias("source"))
    said = spark.sql(_TURNS).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    of = lambda name, rows="rows": F.transform(rows, lambda r: r[name])
    dossiers = said.select(
        "conv_id", F.concat(F.lit(" Reads "), F.coalesce(F.get(F.filter("rows", lambda r: r["turn"] == 0), 0)["interest"]["label"], F.lit(""))).alias("reading_goal"), F.lit(" and   more ").alias("summary"), of("interest").alias("interests"), of("signal").alias("signals"),
        F.transform(F.filter("rows", lambda r: (c("conv_id") % 2 == 0) & (r["turn"] % 2 == 0)), lambda r: r["anchor"]).alias("anchors"), F.transform(F.filter("rows", lambda r: r["avoiding"]), lambda r: r["avoid"]).alias("avoids"), of("source").alias("sources"))
    profile = profiles.compile_profiles(dossiers, "conv_id")
    shown = lambda name, *parts: F.array_join(F.transform(name, lambda e: F.concat(*[F.lit(p) if isinstance(p, str) else p(e) for p in parts])), " | ").alias(name)
    return profile.select(
        "conv_id", "about_me", F.array_join("strong_interests", " | ").alias("strong_interests"), shown("topic_priorities", lambda e: e["id"], "=", lambda e: e["priority"].cast("decimal(9,2)").cast("string"), " ", lambda e: e["guidance"]),
        F.array_join("positive_traits", " | ").alias("positive_traits"), F.array_join("negative_traits", " | ").alias("negative_traits"), shown("interest_anchors", lambda e: e["id"], "=", lambda e: e["text"]),
        shown("avoid_anchors", lambda e: e["id"], "=", lambda e: e["text"], "/", lambda e: e["strength"]), shown("source_preferences", lambda e: e["name"], ":", lambda e: e["disposition"], "/", lambda e: e["role"]),
        F.array_join(F.transform("style_references", lambda e: e["name"]), " | ").alias("style_references"))
