"""Queries of the functions and analytic operators, with the SQL they are checked against (None: checked by tests only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.functions import numbers as N
from loomrank.functions import text as X
from loomrank.functions import urls as U
from loomrank.operators import scoring, selection, stories
from loomrank.plans.shared import park
from loomrank.sources import adapters
from loomrank.sources.adapters import NOW, WITH

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


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.view(spark, sf_dir, "items")


def _cols(name: str, cols: Callable[..., dict], sql: str | None, of: str = "items", key: str = "item_id") -> None:
    """A projection query: key and computed columns over one view or table. cols gets the columns title, summary and url."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        adapters.register(spark, sf_dir)
        base = adapters.view(spark, sf_dir, of) if of in adapters._VIEWS else spark.table(of)
        return base.select(key, *[c.alias(k) for k, c in cols(F.col("title"), F.col("summary"), F.col("url")).items()])

    query(name, sql)(run)


_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + "]"
_TOK = f"list_filter(regexp_split_to_array(translate(lower(coalesce({{}}, '')), '{X.ACCENTED}', '{X.PLAIN}'), '[^a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({_LIST(X.STOP_WORDS)}, t))"

_Q = lambda v: "'" + v.replace("'", "''") + "'"
_ANY = lambda s, ps: "(" + " OR ".join(f"regexp_matches({s}, {_Q('(?i)' + p)})" for p in ps) + ")"
_FIRST = lambda s, ps: "CASE " + " ".join(f"WHEN regexp_matches({s}, {_Q('(?i)' + p)}) THEN {_Q(p)}" for p in ps) + " END"
_TYPE = lambda feed: "CASE " + " ".join(
    f"WHEN {_ANY('hay', ps)} THEN '{t}'" for t, ps in scoring.TYPE_PATTERNS.items()) + f" WHEN {feed} = 'linkblog' THEN 'linkblog' ELSE 'unknown' END"
_HAY = "(SELECT *, title || '  ' || substr(summary, 1, 400) AS hay FROM items)"
_COUNT = lambda words: f"len(list_filter(ws, lambda w: list_contains({_LIST(words)}, w)))"
# verdict and language of {rel}, which has txt and declared
_VERDICT = rf"""(SELECT *, CASE WHEN declared IS NOT NULL AND declared <> 'en' THEN 'non_english' WHEN nl >= 5 AND nl >= en * 1.35e0 THEN 'non_english' WHEN other >= 5 AND other >= en * 1.35e0 THEN 'non_english'
      WHEN en >= 4 AND en >= greatest(nl, other) * 1.25e0 THEN 'english' WHEN declared = 'en' AND len(ws) >= 8 AND nl < 3 AND other < 3 THEN 'english' ELSE 'uncertain' END AS verdict,
    CASE WHEN declared IS NOT NULL AND declared <> 'en' THEN declared WHEN nl >= 5 AND nl >= en * 1.35e0 THEN 'nl' WHEN other >= 5 AND other >= en * 1.35e0 THEN NULL
      WHEN en >= 4 AND en >= greatest(nl, other) * 1.25e0 THEN 'en' ELSE declared END AS lang FROM (
    SELECT *, {_COUNT(X.ENGLISH)} AS en, {_COUNT(X.DUTCH)} AS nl, {_COUNT(X.OTHER)} AS other FROM (
      SELECT *, list_filter(list_transform(regexp_extract_all(lower(txt), '\p{{L}}[\p{{L}}''’.-]*'), lambda w: regexp_replace(w, '[^\p{{L}}]+$', '')), lambda w: length(w) >= 2)[1:1200] AS ws FROM {{rel}})))"""

# text
_cols("x3_collapse", lambda t, s, u: {"out": X.collapse(s)}, r"SELECT item_id, trim(regexp_replace(summary, '\s+', ' ', 'g')) AS out FROM items")
_cols("x5_escape_xml", lambda t, s, u: {"out": X.escape_xml(s)}, """SELECT item_id, replace(replace(replace(replace(replace(summary, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS out FROM items""")
_cols("x6_tokenize", lambda t, s, u: {"out": F.array_join(X.tokenize(t), " ")}, f"SELECT item_id, array_to_string({_TOK.format('title')}, ' ') AS out FROM items")
_cols("x9_reading_minutes", lambda t, s, u: {"minutes": F.coalesce(X.reading_minutes(s), F.lit(0))}, r"""
    SELECT item_id, CASE WHEN n >= 40 THEN greatest(1, floor(n / 230.0 + 0.5))::INT ELSE 0 END AS minutes FROM (SELECT item_id, len(regexp_extract_all(summary, '\S+')) AS n FROM items)""")
_cols("x11_whole_word", lambda t, s, u: {"has_the": X.contains_word(F.lower(s), "the"), "has_ist": X.contains_word(F.lower(s), "ist")}, """
    SELECT item_id, regexp_matches(lower(summary), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS has_the, regexp_matches(lower(summary), '(^|[^a-z0-9])ist([^a-z0-9]|$)') AS has_ist FROM items""")
_cols("x13_publisher", lambda t, s, u: {"out": X.publisher(t)}, "SELECT item_id, regexp_replace(regexp_replace(lower(title), '^the ', ''), '[^a-z0-9]', '', 'g') AS out FROM items")
_cols("x14_slug", lambda t, s, u: {"out": X.slug(t)}, "SELECT item_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS out FROM items")
_cols("x17_language_code", lambda t, s, u: {"code": X.language_code(F.concat("language", F.lit("-XX")))}, "SELECT item_id, lower(split_part(language || '-XX', '-', 1)) AS code FROM items")
_cols("x19_shouting", lambda t, s, u: {"shout": X.shouting(t)}, """
    SELECT item_id, length(l) >= 24 AND length(regexp_replace(l, '[^A-Z]', '', 'g')) >= 0.9 * length(l) AS shout FROM (SELECT item_id, regexp_replace(title, '[^a-zA-Z]', '', 'g') AS l FROM items)""")
_cols("x20_human_minutes", lambda t, s, u: {"out": X.human_minutes(F.col("content_chars") / 100)}, """
    SELECT item_id, CASE WHEN m < 60 THEN m || ' min' ELSE (m // 60) || 'h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || 'm' ELSE '' END END AS out
    FROM (SELECT item_id, floor(content_chars / 100.0 + 0.5)::BIGINT AS m FROM items)""")
_cols("x2_strip_html", lambda t, s, u: {"out": X.strip_html(F.col("html"))}, None, "pages", "page_id")
_cols("x4_truncate", lambda t, s, u: {"out": X.truncate(s, 120)}, """
    SELECT item_id, CASE WHEN length(summary) <= 120 THEN summary ELSE rtrim(CASE WHEN sp > 72 THEN substr(cut, 1, sp) ELSE cut END) || '…' END AS out FROM (
      SELECT *, CASE WHEN instr(cut, ' ') > 0 THEN 120 - instr(reverse(cut), ' ') ELSE -1 END AS sp FROM (SELECT item_id, summary, substr(summary, 1, 120) AS cut FROM items))""")
_cols("x8_named_entities", lambda t, s, u: {"n": F.size(X.named_entities(s)), "first": F.get(F.array_sort(X.named_entities(s)), 0)}, rf"""
    SELECT item_id, len(e)::INT AS n, list_sort(e)[1] AS first FROM (SELECT item_id, list_distinct(list_transform(list_concat(
      list_filter(regexp_extract_all(substr(summary, 1, 4000), '\b([A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*){{0,3}})\b', 1), lambda p: length(p) >= 3 AND (contains(p, ' ') OR (length(p) >= 4 AND NOT list_contains({_LIST(X.STOP_WORDS)}, lower(p))))),
      regexp_extract_all(substr(summary, 1, 4000), '\b([A-Z]{{2,6}})\b', 1)), lambda x: lower(x))) AS e FROM items)""")
_cols("x10_excerpt", lambda t, s, u: {"out": X.excerpt(s, 200)}, """
    SELECT item_id, CASE WHEN length(summary) <= 200 THEN summary ELSE rtrim(substr(summary, 1, 120)) || chr(10) || '[…]' || chr(10) || ltrim(substr(summary, length(summary) - 79, 80)) END AS out FROM items""")
_cols("x12_clean_body", lambda t, s, u: {"n": F.length(X.clean_body(s)), "out": X.clean_body(s)}, """
    SELECT item_id, length(out)::INT AS n, out FROM (SELECT item_id, array_to_string(list_filter(l, lambda x, i: length(x) >= 80 OR list_position(l, x) = i), chr(10) || chr(10)) AS out FROM (
      SELECT item_id, list_filter(list_transform(string_split(coalesce(summary, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT (length(x) < 40 AND regexp_matches(lower(x), '^(advertisement|share|subscribe|sign up|read more|cookie)'))) AS l FROM items))""")
_cols("x15_language", lambda t, s, u: {"v": X.language_verdict(F.concat_ws(" ", "title", "summary"), F.lit(None).cast("string"))["verdict"]},
      "SELECT item_id, verdict AS v FROM " + _VERDICT.replace("{rel}", "(SELECT item_id, title || ' ' || summary AS txt, NULL::VARCHAR AS declared FROM items)"))
# a title that has an "&" of its own is spelled as HTML has it, so it comes back as it was; no entity stands for U+0000 or for the start of an empty title
_HEAD = lambda t, spelled: F.when(F.ascii(t) > 0, spelled).otherwise(F.left(t, F.lit(1)))
_cols("x1_entities", lambda t, s, u: {"out": X.decode_entities(F.concat(_HEAD(t, F.concat(F.lit("&#"), F.ascii(t), F.lit(";"))), F.lit("&amp;#65;"), _HEAD(t, F.concat(F.lit("&#x"), F.hex(F.ascii(t)), F.lit(";"))),
                                                                        F.lit("&#38;lt;&eacute;&#1114112;"), F.replace(t, F.lit("&"), F.lit("&amp;"))))},
      "SELECT item_id, left(title, 1) || '&#65;' || left(title, 1) || '&lt;é&#1114112;' || title AS out FROM items")
_cols("x16_author", lambda t, s, u: {"author": F.trim(F.regexp_replace(F.regexp_extract(t, r"^([A-Za-z]+ [A-Za-z]+)", 1), "(?i)^by ", ""))},
      "SELECT item_id, trim(regexp_replace(regexp_extract(title, '^([A-Za-z]+ [A-Za-z]+)', 1), '(?i)^by ', '')) AS author FROM items")
_cols("x18_template", lambda t, s, u: {"out": F.replace(F.replace(F.lit("{{title}} ({{lang}})"), F.lit("{{title}}"), t), F.lit("{{lang}}"), F.col("language"))},
      "SELECT item_id, title || ' (' || language || ')' AS out FROM items")

# urls
_PATHSQL = r"CASE WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END"
_URLSQL = rf"""(SELECT page_id, url, 'https://' || h || CASE WHEN coalesce(p2, '') = '' THEN '/' ELSE regexp_replace(p2, '/{{2,}}', '/', 'g') END ||
    CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS canon, h FROM (
      SELECT *, {_PATHSQL} AS p2 FROM (
      SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\.', '') AS h,
        regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p,
        list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(({"|".join(U.TRACKING)})(=|$)|{"|".join(U.TRACKING_PREFIX)})')) AS q FROM pages)))"""
_cols("u1_canonical_url", lambda t, s, u: {"canon": U.canonical(u)}, f"SELECT page_id, canon FROM {_URLSQL}", "pages", "page_id")
# ports, parameters of all tracking names and prefixes, and two that stay
_NAMES = [*U.TRACKING, *(p + "x" for p in U.TRACKING_PREFIX)]
_cols("u1_spellings", lambda t, s, u: {"canon": U.canonical(F.concat(
    F.when(F.col("page_id") % 2 == 0, "http://WWW.h").otherwise("https://h"), (F.col("page_id") % 9).cast("string"), F.element_at(F.array(*map(F.lit, (".org:80", ".org:443", ".org:8080", ".org."))), (F.floor(F.col("page_id") / 2) % 4 + 1).cast("int")),
    F.lit("/a//b/?b=2&"), F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % len(_NAMES) + 1).cast("int")), F.lit("=x&a=1#top")))},
      "SELECT page_id, 'https://h' || page_id % 9 || '.org' || CASE page_id // 2 % 4 WHEN 0 THEN CASE WHEN page_id % 2 = 0 THEN '' ELSE ':80' END WHEN 2 THEN ':8080' ELSE '' END || '/a/b?a=1&b=2' AS canon FROM pages", "pages", "page_id")
_cols("u2_host", lambda t, s, u: {"host": U.host(u)}, f"SELECT page_id, h AS host FROM {_URLSQL}", "pages", "page_id")
_cols("u3_domain", lambda t, s, u: {"domain": U.domain(u)}, f"SELECT page_id, split_part(h, '.', -2) || '.' || split_part(h, '.', -1) AS domain FROM {_URLSQL}", "pages", "page_id")
_cols("u5_same_article", lambda t, s, u: {"same": U.same_article(u, F.concat(u, F.lit("?utm_x=1")))}, None, "pages", "page_id")
_cols("u6_search_link", lambda t, s, u: {"link": U.search_link("https://www.youtube.com/results?search_query=", F.regexp_replace(t, "[^A-Za-z ]", ""))},
      "SELECT item_id, 'https://www.youtube.com/results?search_query=' || replace(substr(regexp_replace(title, '[^A-Za-z ]', '', 'g'), 1, 120), ' ', '%20') AS link FROM items")
_cols("u7_media_format", lambda t, s, u: {"kind": U.media_format(F.concat(u, F.when(F.col("page_id") % 3 == 0, ".mp3").otherwise("")), F.lit("text"))},
      r"SELECT page_id, CASE WHEN page_id % 3 = 0 AND regexp_matches(url || '.mp3', '\.mp3([?#]|$)') THEN 'audio' ELSE 'text' END AS kind FROM pages", "pages", "page_id")
_cols("u8_podcast_platform", lambda t, s, u: {"kind": U.podcast_platform(F.concat(F.lit("https://open.spotify.com/x/"), F.col("page_id")))}, "SELECT page_id, 'spotify' AS kind FROM pages", "pages", "page_id")

# times, numbers, hashes, vectors, JSON
_cols("t2_day_key", lambda t, s, u: {"day": F.to_date(F.timestamp_millis("first_seen_at")).cast("string")}, "SELECT item_id, strftime(make_timestamp(first_seen_at * 1000), '%Y-%m-%d') AS day FROM items")
_cols("t3_run_rate", lambda t, s, u: {"month": F.date_format(F.timestamp_millis("first_seen_at"), "yyyy-MM"), "rate": N.run_rate(F.col("free_score"), F.timestamp_millis("first_seen_at"))}, """
    SELECT item_id, strftime(d, '%Y-%m') AS month, free_score / day(d) * day(last_day(d::DATE)) AS rate FROM (SELECT item_id, free_score, make_timestamp(first_seen_at * 1000) AS d FROM items)""")
_cols("t4_clock_minutes", lambda t, s, u: {"m": F.round(N.clock_minutes(F.concat_ws(":", (F.col("item_id") % 3), (F.col("item_id") % 60), (F.col("item_id") % 59))), 6)},
      "SELECT item_id, round((item_id % 3) * 60 + (item_id % 60) + (item_id % 59) / 60.0, 6)::DOUBLE AS m FROM items")
_cols("t5_iso_minutes", lambda t, s, u: {"m": N.iso_minutes(F.concat(F.lit("PT"), F.col("item_id") % 5, F.lit("H"), F.col("item_id") % 50, F.lit("M")))}, "SELECT item_id, ((item_id % 5) * 60 + item_id % 50)::DOUBLE AS m FROM items")
_cols("t6_rfc822", lambda t, s, u: {"out": F.date_format(F.timestamp_millis("first_seen_at"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")}, "SELECT item_id, strftime(make_timestamp(first_seen_at * 1000), '%a, %d %b %Y %H:%M:%S GMT') AS out FROM items")
_cols("t7_half_life", lambda t, s, u: {"f": F.round(N.half_life((F.lit(NOW) - F.col("first_seen_at")) / 864e5, F.lit(14.0), F.lit(0.3)), 6)},
      f"SELECT item_id, round(least(1, greatest(0, 0.3 + 0.7 * pow(0.5, greatest(0, ({NOW} - first_seen_at) / 864e5) / 14.0))), 6)::DOUBLE AS f FROM items")
_cols("t8_proximity", lambda t, s, u: {"p": F.round(N.proximity(F.col("item_id") % 120, 96.0), 6)}, "SELECT item_id, round(greatest(0, 1 - (item_id % 120) / 96e0), 6) AS p FROM items")
_cols("t1_parse_date", lambda t, s, u: {"at": N.parse_date(F.element_at(F.array(F.lit("2026-08-19T12:50:00Z"), F.lit("Wed, 19 Aug 2026 12:50:00 +0000"), F.lit("19 August 2026 - 12:50"), F.lit("soon")), (F.col("item_id") % 4 + 1).cast("int")))},
      "SELECT item_id, CASE WHEN item_id % 4 < 3 THEN TIMESTAMP '2026-08-19 12:50:00' END AS at FROM items")
_cols("m1_rescale", lambda t, s, u: {"r": F.round(N.rescale(F.col("free_score"), .1, .55), 6)}, "SELECT item_id, round(least(1e0, greatest(0e0, (free_score - 0.1e0) / 0.45e0)), 6) AS r FROM items")
_cols("m2_decay", lambda t, s, u: {"d": N.decay_at(selection.SOURCE_DECAY, .2, F.col("item_id") % 9)}, "SELECT item_id, coalesce(([1, .9, .75, .55, .4, .28]::DOUBLE[])[(item_id % 9 + 1)::INT], 0.2e0) AS d FROM items")
_cols("m3_fnv1a", lambda t, s, u: {"h": N.fnv1a(F.concat(F.lit("item:"), F.col("item_id")))}, """
    SELECT item_id, list_reduce(list_transform(string_split('item:' || item_id, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM items""")
_cols("m4_stable_id", lambda t, s, u: {"id": N.stable_id(F.col("source_id"), F.col("item_id"))}, "SELECT item_id, left(sha256(source_id || ' ' || item_id), 20) AS id FROM items")
_cols("m5_content_hash", lambda t, s, u: {"h": F.substring(F.sha2(s, 256), 1, 12)}, "SELECT item_id, left(sha256(summary), 12) AS h FROM items")
_cols("m12_half_up", lambda t, s, u: {"r": N.half_up(F.col("free_score") * 10)}, "SELECT item_id, floor(free_score * 10 + 0.5)::DOUBLE AS r FROM items")
_cols("m13_token_cost", lambda t, s, u: {"c": F.round(N.token_cost(F.col("input_tokens") - F.col("cached_tokens"), F.col("cached_tokens"), F.col("output_tokens"), (2.0, .2, 12.0)), 9)},
      "SELECT event_id, round(((input_tokens - cached_tokens) * 2e0 + cached_tokens * 0.2e0 + output_tokens * 12e0) / 1e6, 9) AS c FROM usage_ledger", "usage_ledger", "event_id")
_cols("m14_shrunk_priority", lambda t, s, u: {"p": N.shrunk_priority(F.col("item_id") % 11, F.col("free_score"))}, "SELECT item_id, floor((5 + (item_id % 11 - 5) * free_score) * 100 + 0.5) / 100e0 AS p FROM items")
_cols("n1_string_array", lambda t, s, u: {"n": F.size(N.string_array(F.when(F.col("item_id") % 2 == 0, '["a","b"]').otherwise("oops")))}, "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END::INT AS n FROM items")
_cols("n3_repair_json", lambda t, s, u: {"v": F.try_variant_get(N.repair_json(F.concat(F.lit("{“a”: "), F.col("item_id"), F.lit(", \"b\": None,}"))), "$.a", "long")}, "SELECT item_id, item_id AS v FROM items")
_cols("n4_score", lambda t, s, u: {"v": N.score(F.element_at(F.array(F.lit("85%"), F.lit("0,7"), F.lit("42"), F.lit("x"), F.lit("1.5")), (F.col("item_id") % 5 + 1).cast("int")))},
      "SELECT item_id, ([0.85, 0.7, 0.42, 0, 1]::DOUBLE[])[(item_id % 5 + 1)::INT] AS v FROM items")
_cols("n5_truthy", lambda t, s, u: {"v": N.truthy(F.when(F.col("item_id") % 3 == 0, "Yes").when(F.col("item_id") % 3 == 1, "off"))}, "SELECT item_id, item_id % 3 = 0 AS v FROM items")
_cols("n6_action", lambda t, s, u: {"v": N.action(F.when(F.col("item_id") % 3 == 0, " keep").when(F.col("item_id") % 3 == 1, "maybe").otherwise("DROP"))},
      "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'UNCERTAIN' ELSE 'DROP' END AS v FROM items")
_cols("n9_json_number", lambda t, s, u: {"k": N.json_number(F.col("props"), "$.k", .5)}, "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.5e0) AS k FROM events", "events", "event_id")
_cols("n10_nearest_enum", lambda t, s, u: {"v": F.when(t.startswith("The"), "the").when(F.lower(t).startswith("a"), "a").otherwise("other")},
      "SELECT item_id, CASE WHEN starts_with(title, 'The') THEN 'the' WHEN starts_with(lower(title), 'a') THEN 'a' ELSE 'other' END AS v FROM items")
_cols("n11_category", lambda t, s, u: {"v": F.coalesce(F.get(F.filter(F.array(F.col("category"), F.lit("games")), lambda c: c.isin("games", "culture")), 0), F.lit("other"))},
      "SELECT item_id, CASE WHEN category = 'culture' THEN 'culture' ELSE 'games' END AS v FROM items")

# filters and scores over items
_cols("f2_thin", lambda t, s, u: {"thin": F.length(s) + F.col("content_chars") < 500}, "SELECT item_id, length(summary) + content_chars < 500 AS thin FROM items")
_cols("f3_first_pattern", lambda t, s, u: {"rule": scoring.first_match(t, ["(?i)^the ", "(?i)^a", "(?i)er"])},
      "SELECT item_id, CASE WHEN regexp_matches(title, '(?i)^the ') THEN '(?i)^the ' WHEN regexp_matches(title, '(?i)^a') THEN '(?i)^a' WHEN regexp_matches(title, '(?i)er') THEN '(?i)er' END AS rule FROM items")
_cols("f4_host_suffix", lambda t, s, u: {"hit": scoring.host_in(U.host(u), ["example.org", "example.com"])}, f"SELECT page_id, h LIKE '%.example.org' OR h LIKE '%.example.com' AS hit FROM {_URLSQL}", "pages", "page_id")
_cols("f5_category_blocklist", lambda t, s, u: {"hit": scoring.blocked_category(F.array(F.upper("category"), F.lit("x")), ["games", "culture"])}, "SELECT item_id, category IN ('games', 'culture') AS hit FROM items")
_cols("f6_age", lambda t, s, u: {"old": F.coalesce(F.col("publication_time") < F.lit(NOW - 14 * N.DAY), F.lit(False))}, f"SELECT item_id, coalesce(publication_time < {NOW - 14 * N.DAY}, false) AS old FROM items")
_cols("f7_type_expiry", lambda t, s, u: {"gone": scoring.expired(F.col("publication_time"), F.when(F.col("item_id") % 2 == 0, "news").otherwise("essay"), NOW)},
      f"SELECT item_id, coalesce(item_id % 2 = 0 AND {NOW} - publication_time > 5 * 86400000, false) AS gone FROM items")
_cols("f8_requeue", lambda t, s, u: {"ok": F.coalesce(F.lit(NOW) - F.col("publication_time") <= scoring.lookup(F.col("category"), {"games": 72, "culture": 1440}, 336).cast("long") * N.HOUR, F.lit(True))},
      f"SELECT item_id, coalesce({NOW} - publication_time <= (CASE category WHEN 'games' THEN 72 WHEN 'culture' THEN 1440 ELSE 336 END)::BIGINT * {N.HOUR}, true) AS ok FROM items")
_cols("r1_editorial_type", lambda t, s, u: {"kind": scoring.editorial_type(t, s, F.lit("article"))}, f"SELECT item_id, {_TYPE(_Q('article'))} AS kind FROM {_HAY}")
_WORD = lambda s, w: f"regexp_matches(lower({s}), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')"
_cols("r3_keyword_interest", lambda t, s, u: {"k": F.round(scoring.keyword_interest(t, s, ["the", "of", "ist", "in the"]), 6)}, f"""
    SELECT item_id, round(least(1e0, ({" + ".join(f"CASE WHEN {_WORD('title', w)} THEN 2e0 WHEN {_WORD('summary', w)} THEN 1e0 ELSE 0e0 END" for w in ("the", "of", "ist"))}
      + CASE WHEN contains(lower(title), 'in the') THEN 2e0 WHEN contains(lower(summary), 'in the') THEN 1e0 WHEN {_WORD('title', 'in')} AND {_WORD('title', 'the')} THEN 1.2e0
             WHEN {_WORD('summary', 'in')} AND {_WORD('summary', 'the')} THEN 0.6e0 ELSE 0e0 END) / 6e0), 6) AS k FROM items""")
_cols("r5_clickbait", lambda t, s, u: {"c": F.round(scoring.clickbait(F.concat(t, F.when(F.col("category") == "games", " slams shocking?!").otherwise(""))), 6)},
      "SELECT item_id, round(least(1e0, 0.35e0 * (" + " + ".join(f"regexp_matches(x, {_Q('(?i)' + p)})::INT" for p in scoring.CLICKBAIT)
      + ")), 6) AS c FROM (SELECT item_id, title || CASE WHEN category = 'games' THEN ' slams shocking?!' ELSE '' END AS x FROM items)")
_cols("r6_volume_penalty", lambda t, s, u: {"p": F.round(scoring.volume_penalty(F.col("item_id") % 12 + 1, F.lit(0.5)), 6)}, """
    SELECT item_id, CASE WHEN item_id % 12 = 0 THEN 0e0 ELSE round(1 - coalesce(([1.0, .92, .82, .68, .50, .36, .25]::DOUBLE[])[(floor((item_id % 12) / 0.5) + 1)::INT], 0.18e0), 6) END AS p FROM items""")
_cols("r7_redundancy", lambda t, s, u: {"p": scoring.redundancy(F.col("free_score"), F.col("item_id") % 2 == 0, F.lit(0.5))},
      "SELECT item_id, CASE WHEN free_score >= 0.94e0 THEN 1e0 WHEN item_id % 2 = 0 THEN 0.45e0 * 0.75e0 ELSE 0e0 END AS p FROM items")
_cols("r8_exploring_quality", lambda t, s, u: {"q": F.round(scoring.exploring_quality(F.col("quality_prior"), F.col("n") * 3, F.col("exploration_floor")), 6)},
      "SELECT source_id, round(CASE WHEN n * 3 >= 25 THEN quality_prior ELSE quality_prior + 0.6e0 * (greatest(quality_prior, 0.5e0 + exploration_floor) - quality_prior) END, 6) AS q FROM sources", "sources", "source_id")
_cols("r10_bands", lambda t, s, u: {"band": scoring.band(F.col("free_score"))}, "SELECT item_id, CASE WHEN free_score >= 0.396e0 THEN 'A' WHEN free_score >= 0.299e0 THEN 'B' WHEN free_score >= 0.242e0 THEN 'C' ELSE 'D' END AS band FROM items")
_cols("r15_serendipity", lambda t, s, u: {"v": F.round(scoring.serendipity(F.col("expected_attention_value"), F.col("novelty"), F.lit(0.2), F.col("anchor_distance"), 1.5, .5), 6)},
      "SELECT item_id, round(expected_attention_value * pow(greatest(novelty, 0.2e0), 1.5e0) * pow(anchor_distance, 0.5e0), 6) AS v FROM deep", "deep")
_FEED = {"expected_attention_value": .5, "novelty": .3, "ragebait": -.4}
_GATES = {"max_ragebait": .35, "min_novelty": .4, "max_duplicate_information": .6}
_GATESQL = "CASE WHEN ragebait > 0.35e0 THEN 'max_ragebait' WHEN novelty < 0.4e0 THEN 'min_novelty' WHEN duplicate_information > 0.6e0 THEN 'max_duplicate_information' END"
_cols("r14_feed_score", lambda t, s, u: scoring.feed_verdict(_FEED, _GATES, .35), f"""
    SELECT item_id, v, gate IS NULL AND v >= 0.35e0 AS admitted, CASE WHEN gate IS NOT NULL THEN 'gate:' || gate WHEN v < 0.35e0 THEN 'below_min_score' ELSE 'ok' END AS reason FROM (
      SELECT item_id, {_GATESQL} AS gate, round((0.5e0 * expected_attention_value + 0.3e0 * novelty - 0.4e0 * ragebait) / 0.8e0, 6) AS v FROM deep)""", "deep")
_cols("r14b_serendipity_feed", lambda t, s, u: scoring.feed_verdict(_FEED, {"max_ragebait": .35, "min_distance": .3}, .2, serendipity_of={"expected_attention_value": 1.0, "novelty": 1.0}), """
    SELECT item_id, v, gate IS NULL AND v >= 0.2e0 AS admitted, CASE WHEN gate IS NOT NULL THEN 'gate:' || gate WHEN v < 0.2e0 THEN 'below_min_score' ELSE 'ok' END AS reason FROM (
      SELECT item_id, CASE WHEN ragebait > 0.35e0 THEN 'max_ragebait' WHEN anchor_distance < 0.3e0 THEN 'min_distance' END AS gate,
        round((expected_attention_value + novelty) / 2e0 * novelty * anchor_distance, 6) AS v FROM deep)""", "deep")
_cols("m11_quality_mean", lambda t, s, u: {"q": F.round(scoring.quality_mean({"a": .5, "b": .3, "c": .2}), 6)}, """
    SELECT item_id, round(CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 0 ELSE (coalesce(0.5e0 * a, 0) + coalesce(0.3e0 * b, 0) + coalesce(0.2e0 * c, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.5e0 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3e0 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2e0 END) END, 6) AS q
    FROM declared""", "declared")
_cols("f12_gates", lambda t, s, u: {"gate": scoring.gates({"max_ragebait": .35, "min_novelty": .4, "max_duplicate_information": .6})},
      "SELECT item_id, CASE WHEN ragebait > 0.35e0 THEN 'max_ragebait' WHEN novelty < 0.4e0 THEN 'min_novelty' WHEN duplicate_information > 0.6e0 THEN 'max_duplicate_information' END AS gate FROM deep", "deep")
_cols("f13_admission", lambda t, s, u: {"ok": F.col("category").isin("games", "culture") | F.array_contains(F.array(F.when(F.col("item_id") % 7 == 0, "mine").otherwise("x")), "mine")},
      "SELECT item_id, category IN ('games', 'culture') OR item_id % 7 = 0 AS ok FROM items")
_cols("r21_attention", lambda t, s, u: {"m": scoring.attention(F.col("content_chars") / 6, F.when(F.col("item_id") % 2 == 0, 3.0), F.when(F.col("item_id") % 3 == 0, 4.0), F.lit(None).cast("double"))}, """
    SELECT item_id, CASE WHEN content_chars / 6e0 > 200 THEN greatest(1e0, floor(content_chars / 6e0 / 230 + 0.5)) WHEN item_id % 2 = 0 THEN 3e0 WHEN item_id % 3 = 0 THEN 4e0 ELSE 8e0 END AS m FROM items""")
_cols("r44_stub_models", lambda t, s, u: {"action": F.when(N.hash_unit(F.concat(F.lit("stub:"), F.col("item_id"))) >= .6, "KEEP").otherwise("DROP")}, """
    SELECT item_id, CASE WHEN (list_reduce(list_transform(string_split('stub:' || item_id, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) % 100000) / 1e5 >= 0.6e0
    THEN 'KEEP' ELSE 'DROP' END AS action FROM items""")


_EXPIRES = " ".join(f"WHEN '{k}' THEN {c[1]}" for k, c in scoring.CURVES.items() if c[1])


@query("f1_rule_filter", f"""
    SELECT item_id, thin, rule IS NULL AS keep, rule AS matched_rule FROM (SELECT *, CASE
      WHEN access <> 'free' THEN 'access:' || access WHEN item_id % 53 = 0 THEN 'drop_podcast_items'
      WHEN trim(title) = '' AND url IS NULL THEN 'malformed' WHEN length(trim(title)) < 8 AND trim(title) <> '' AND url IS NULL THEN 'min_title_length'
      WHEN by_title IS NOT NULL THEN by_title WHEN {" OR ".join(f"h = '{h}' OR ends_with(h, '.{h}')" for h in scoring.PAYWALL_HOSTS)} THEN 'paywall_host'
      WHEN NOT coalesce(lang = 'en' AND verdict <> 'uncertain', false) THEN CASE WHEN lang IS NOT NULL THEN 'allowed_languages' ELSE 'allowed_languages_uncertain' END
      WHEN by_url IS NOT NULL THEN by_url WHEN category IN ({", ".join(map(_Q, scoring.CATEGORY_BLOCKLIST))}) THEN 'feed_category'
      WHEN publication_time < {NOW} - 14 * 86400000 THEN 'max_item_age_days'
      WHEN {NOW} - publication_time > (CASE kind {_EXPIRES} END)::BIGINT * 86400000 THEN 'expires_after_days:' || kind END AS rule
    FROM (SELECT *, length(summary) < 120 AS thin, {_FIRST('trim(title)', scoring.TITLE_PATTERNS)} AS by_title, {_FIRST('url', scoring.URL_PATTERNS)} AS by_url, {_TYPE('feed_type')} AS kind
      FROM {_VERDICT.replace("{rel}", f"""(SELECT i.*, s.access, s.feed_type, p.url, p.h, title || ' ' || summary AS txt, title || '  ' || substr(summary, 1, 400) AS hay,
        nullif(lower(split_part(language, '-', 1)), '') AS declared FROM items i LEFT JOIN sources s USING (source_id) LEFT JOIN {_URLSQL} p ON p.page_id = i.item_id)""")}))""")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = adapters.view(spark, sf_dir, "sources").select("source_id", "access", "feed_type")
    pages = spark.table("pages").select(F.col("page_id").alias("item_id"), F.col("url"), U.host(F.col("url")).alias("host"))
    items = (_items(spark, sf_dir).join(src, "source_id", "left").join(pages, "item_id", "left")
             .withColumns({"categories": F.array("category"), "is_podcast": F.col("item_id") % 53 == 0}))
    return scoring.rule_filter(items, NOW).select("item_id", "thin", "keep", "matched_rule")


INTERESTS = ["the", "of", "in the"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, src = _items(spark, sf_dir), adapters.view(spark, sf_dir, "sources")
    anchors = adapters.view(spark, sf_dir, "anchors").where(~F.col("avoid"))
    avoid = adapters.view(spark, sf_dir, "anchors").where("avoid").select(F.col("anchor").alias("avoid_anchor"))
    vec = adapters.view(spark, sf_dir, "vectors")
    # three interest anchors and one to avoid: a table of four rows
    sims = (vec.crossJoin(F.broadcast(anchors)).groupBy("item_id").agg(F.sort_array(F.collect_list(N.cosine(F.col("embedding"), F.col("anchor")))).alias("sims"), F.first("embedding").alias("e"))
            .crossJoin(F.broadcast(avoid)).select("item_id", N.top_mean(F.col("sims")).alias("anchor_mean"), F.greatest(F.lit(0.0), N.cosine(F.col("e"), F.col("avoid_anchor"))).alias("avoid")))
    seen = items.groupBy("source_id").agg(F.count("*").alias("items_seen"))
    # a source's uniqueness: the share of its items in clusters of its own, drawn to 0.5 while it has few
    spread = items.groupBy("cluster_id").agg(F.min("source_id").alias("lo"), F.max("source_id").alias("hi"))
    own = (items.join(spread, "cluster_id").groupBy("source_id")
           .agg(((F.sum(F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(0.0)) + 4.0) / (F.count("*") + 8)).alias("uniqueness")))
    # of the nearest neighbour the score asks only whether it is a near copy
    nearest = park(stories.near_copies(_stories(spark, sf_dir), scoring.NEAR_COPY))
    told = scoring.text_parts(items.drop("free_score"), INTERESTS)
    return (told.join(src, "source_id", "left").join(sims, "item_id", "left").join(seen, "source_id").join(own, "source_id")
            .join(nearest, "item_id", "left")
            .withColumns({"nearest": F.coalesce("nearest", F.lit(0.0)), "category_prior": F.lit(None).cast("double"),
                          "discovery": F.when(F.col("feed_type") == "discovery", F.col("quality_prior"))}))


@query("r9_free_score")
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.free_score(_scored(spark, sf_dir), NOW, INTERESTS).select("item_id", F.round("free_score", 6).alias("free_score"), "band", "editorial_type", "rank_in_run")


@query("r12_free_ranker")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item: bands A and B share the slots in score order; of the rest a hash sample is audited, up to a cap, in score order."""
    ranked = park(scoring.free_score(_scored(spark, sf_dir), NOW, INTERESTS).select("item_id", "free_score", "band"))
    return scoring.slots_and_audits(ranked, slots=140, audit_cap=20).select("item_id", F.round("free_score", 6).alias("free_score"), "band", "selected", "audit", "reason")


@query("m6_cosine", "SELECT v.item_id, a.anchor_id, round(list_cosine_similarity(v.embedding::DOUBLE[], a.anchor::DOUBLE[]), 6) AS c FROM vectors v CROSS JOIN anchors a")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = adapters.view(spark, sf_dir, "vectors")
    return vec.crossJoin(F.broadcast(adapters.view(spark, sf_dir, "anchors"))).select("item_id", "anchor_id", F.round(N.cosine(F.col("embedding"), F.col("anchor")), 6).alias("c"))


@query("m8_anchor_match", """
    SELECT item_id, max_by(anchor_id, c) AS best, round(max(c), 6) AS sim, round(least(1, greatest(0, 1 - avg(c))), 6) AS distance FROM
    (SELECT v.item_id, a.anchor_id, list_cosine_similarity(v.embedding::DOUBLE[], a.anchor::DOUBLE[]) AS c FROM vectors v CROSS JOIN anchors a WHERE NOT a.avoid) GROUP BY item_id""")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, anchors = adapters.view(spark, sf_dir, "vectors"), adapters.view(spark, sf_dir, "anchors").where(~F.col("avoid"))
    c = vec.crossJoin(F.broadcast(anchors)).select("item_id", "anchor_id", N.cosine(F.col("embedding"), F.col("anchor")).alias("c"))
    return c.groupBy("item_id").agg(F.max_by("anchor_id", "c").alias("best"), F.round(F.max("c"), 6).alias("sim"), F.round(N.clamp(1 - F.avg("c")), 6).alias("distance"))


_FOLD = "list_reduce(list_transform(string_split(tok, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295, 0::BIGINT)"


@query("m7_hash_embedding", f"""
    , h AS (SELECT item_id, {_FOLD} AS h FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9_]+'), lambda x: x <> '')) AS tok FROM items)),
    b AS (SELECT item_id, h % 256 AS bucket, 1e0 AS w FROM h UNION ALL SELECT item_id, (h >> 7) % 256, 0.5e0 FROM h),
    s AS (SELECT item_id, bucket, sum(w) AS w FROM b GROUP BY item_id, bucket)
    SELECT item_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM s""")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector's entries other than 0: tokens add 1 to one bucket and a half to another, and the sums are brought to length 1."""
    toks = _items(spark, sf_dir).select("item_id", F.explode(F.array_remove(F.split(F.lower("title"), "[^a-z0-9_]+"), "")).alias("tok"))
    return N.hash_embedding(toks, "item_id", "tok").withColumn("weight", F.round("weight", 6))


@query("x7_title_jaccard", f"""
    SELECT a.item_id, b.item_id AS other, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE END, 6) AS j FROM
    (SELECT item_id, cluster_id, list_distinct({_TOK.format('title')}) AS t FROM items) a JOIN (SELECT item_id, cluster_id, list_distinct({_TOK.format('title')}) AS t FROM items) b
    ON a.cluster_id = b.cluster_id AND a.item_id < b.item_id""")
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).select("item_id", "cluster_id", F.array_distinct(X.tokenize(F.col("title"))).alias("t"))
    a, b = i.alias("a"), i.alias("b")
    return (a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.item_id") < F.col("b.item_id")))
            .select("a.item_id", F.col("b.item_id").alias("other"), F.round(X.jaccard(F.col("a.t"), F.col("b.t")), 6).alias("j")))


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = adapters.view(spark, sf_dir, "vectors").select("item_id", "embedding")
    items = _items(spark, sf_dir).select("item_id", "source_id", "title", "summary", F.lit(None).cast("string").alias("url"), F.coalesce("publication_time", "first_seen_at").alias("at"))
    return stories.read(items).join(vec, "item_id", "left")


@query("j13_nearest_in_window", """
    SELECT a.item_id, round(greatest(0e0, max(list_cosine_similarity(a.e, b.e))), 6) AS nearest FROM
    (SELECT v.item_id, coalesce(publication_time, first_seen_at) AS at, embedding::DOUBLE[] AS e FROM vectors v JOIN items i USING (item_id)) a JOIN
    (SELECT v.item_id, coalesce(publication_time, first_seen_at) AS at, embedding::DOUBLE[] AS e FROM vectors v JOIN items i USING (item_id)) b
    ON a.item_id <> b.item_id AND abs(a.at - b.at) <= 96 * 3600000 GROUP BY a.item_id""")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.nearest(_stories(spark, sf_dir)).withColumn("nearest", F.round("nearest", 6))


FEEDS = [{"feed": "essential", "cap": 8, "minutes": 45, "category_cap": 3, "min_score": .72, "protected": 0}, {"feed": "games", "cap": 8, "minutes": 40, "category_cap": 8, "min_score": .52, "protected": 0},
         {"feed": "serendipity", "cap": 3, "minutes": 30, "category_cap": 2, "min_score": .34, "protected": 1}]


@query("r19_editions")
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep, items = adapters.view(spark, sf_dir, "deep"), _items(spark, sf_dir)
    src = adapters.view(spark, sf_dir, "sources").select("source_id", "quality_prior")
    c = (deep.join(items.select("item_id", "source_id", "cluster_id", "category"), "item_id").where("ragebait <= 0.35")
         .join(src, "source_id", "left").join(r39(spark, sf_dir), "source_id", "left"))
    value = selection.base_value(F.col("expected_attention_value"), F.coalesce("quality_prior", F.lit(.5)), F.coalesce("learned", F.lit(0.0)), F.lit(.6))
    per_feed = c.withColumn("feed", F.explode(F.array(*[F.lit(f["feed"]) for f in FEEDS])))
    return selection.editions(per_feed.select(
        "feed", "item_id", "source_id", "cluster_id", "category", value.alias("score"), "duplicate_information",
        (3.0 + F.col("item_id") % 12).alias("minutes"), (F.col("anchor_distance") >= .55).alias("exploratory")), FEEDS, keep=park)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cheap, items = adapters.view(spark, sf_dir, "cheap"), _items(spark, sf_dir)
    return scoring.opportunity(cheap.join(items, "item_id").withColumns({
        "interest": F.col("free_score"), "novelty": F.col("triage_score"), "quality_prior": F.lit(.6), "differentiation": F.lit(1.0), "feed_need": F.lit(.5),
        "serendipity_potential": F.lit(.1), "audit": F.col("is_audit_sample")}))


_OPP = """least(1e0, greatest(0e0, .30e0 * free_score + .16e0 * triage_score + .08e0 * least(1e0, triage_score) + .14e0 * free_score + .10e0 * .6e0 + .10e0 + .08e0 * .5e0 + .04e0 * .1e0
    - .5e0 * junk_probability + CASE WHEN action = 'UNCERTAIN' THEN .10e0 ELSE 0e0 END))"""


@query("r31_opportunity", f"SELECT item_id, round({_OPP}, 6) AS opportunity FROM cheap JOIN items USING (item_id)")
def r31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("item_id", F.round("opportunity", 6).alias("opportunity"))


@query("r32_allocation")
def r32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate: bought (with its place and score), expired (published too long ago for its kind), else deferred to the next run."""
    c = _candidates(spark, sf_dir).withColumn("late", scoring.expired(F.col("publication_time"), F.when(F.col("category") == "games", "news").otherwise("essay"), NOW))
    bought = selection.allocate(c.where(~F.col("late")), [("run", 60, .30)]).select("item_id", "place", F.round("score", 6).alias("score"))
    return (c.select("item_id", "late").join(F.broadcast(bought), "item_id", "left")
            .select("item_id", "place", "score", F.when(F.col("late"), "expired").when(F.col("place").isNotNull(), "bought").otherwise("deferred").alias("decision")))


@query("r50_budget_replay")
def r50(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = selection.allocate(_candidates(spark, sf_dir), [(f"${d}", 15 * d, .30) for d in range(1, 9)])
    kept = adapters.view(spark, sf_dir, "published").select("item_id").distinct()
    return picks.join(kept.withColumn("good", F.lit(1)), "item_id", "left").groupBy("budget").agg(F.count("*").alias("bought"), F.coalesce(F.sum("good"), F.lit(0)).alias("retained"))


@query("f17_triage_gate", """
    SELECT item_id, round(.35e0 * free_score + .45e0 * triage_score + .25e0 * ((item_id * 7) % 100) / 1e2 + .12e0 * .6e0 - 1.2e0 * junk_probability, 6) AS gate_score,
      CASE WHEN ((item_id * 3) % 100) / 1e2 >= .55e0 AND ((item_id * 7) % 100) / 1e2 >= .55e0 AND junk_probability <= .35e0 THEN true WHEN is_audit_sample THEN true WHEN action = 'DROP' THEN false
        ELSE round(.35e0 * free_score + .45e0 * triage_score + .25e0 * ((item_id * 7) % 100) / 1e2 + .12e0 * .6e0 - 1.2e0 * junk_probability, 6) >=
          round(CASE category WHEN 'ideas_science' THEN .44e0 WHEN 'culture' THEN .46e0 WHEN 'games' THEN .50e0 WHEN 'ai_product' THEN .55e0 ELSE .50e0 END
          - CASE WHEN action = 'UNCERTAIN' THEN .10e0 ELSE 0e0 END - CASE WHEN free_score >= .396e0 THEN .06e0 ELSE 0e0 END, 6) END AS passed FROM cheap JOIN items USING (item_id)""")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.view(spark, sf_dir, "cheap").join(_items(spark, sf_dir), "item_id").drop("passed").withColumns({
        "interest": F.col("triage_score"), "novelty": (F.col("item_id") * 7 % 100) / 1e2, "distance": (F.col("item_id") * 3 % 100) / 1e2, "quality_prior": F.lit(.6), "band": scoring.band(F.col("free_score"))})
    g = scoring.triage_gate(d)
    return g.select("item_id", F.round("gate_score", 6).alias("gate_score"), "passed")


@query("r39_learning", """
    SELECT source_id, round(least(0.40e0, greatest(-0.25e0, CASE WHEN abs(0.04e0 * mean) < 0.0005e0 THEN 0e0 ELSE 0.04e0 * mean END)), 6) AS learned FROM
    (SELECT source_id, count(*) AS n, sum(CASE kind WHEN 'excellent' THEN 5e0 ELSE -5e0 END) / (count(*) + 12) AS mean FROM feedback JOIN items USING (item_id) GROUP BY source_id) WHERE n >= 8""")
def r39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of the moving average from a zero state: at least eight events, clamped, with a dead band."""
    j = adapters.view(spark, sf_dir, "feedback").join(_items(spark, sf_dir), "item_id")
    m = j.groupBy("source_id").agg(F.count("*").alias("n"), (F.sum(F.when(F.col("kind") == "excellent", 5.0).otherwise(-5.0)) / (F.count("*") + 12)).alias("mean")).where("n >= 8")
    step = 0.04 * F.col("mean")
    return m.select("source_id", F.round(N.clamp(F.when(F.abs(step) < .0005, 0.0).otherwise(step), -.25, .40), 6).alias("learned"))


_SIMS = "SELECT v.item_id, a.anchor_id, a.avoid, list_cosine_similarity(v.embedding::DOUBLE[], a.anchor::DOUBLE[]) AS c FROM vectors v, anchors a"


def _anchor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, wanted (array of c, anchor_id): every vector against the profile's anchors; these are one row per interest, so they are broadcast."""
    anchors = adapters.view(spark, sf_dir, "anchors").where("NOT avoid").select("anchor_id", "anchor")
    v = adapters.view(spark, sf_dir, "vectors").crossJoin(F.broadcast(anchors))
    return v.select("item_id", "anchor_id", N.cosine(F.col("embedding"), F.col("anchor")).alias("c"))


@query("j16_item_anchors", f"SELECT item_id, anchor_id, round(c, 6) AS c FROM ({_SIMS}) WHERE NOT avoid")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchor_scores(spark, sf_dir).select("item_id", "anchor_id", F.round("c", 6).alias("c"))


@query("s6_top_mean", f"SELECT item_id, round(avg(c), 6) AS top FROM (SELECT item_id, c, row_number() OVER (PARTITION BY item_id ORDER BY c DESC) AS r FROM ({_SIMS}) WHERE NOT avoid) WHERE r <= 2 GROUP BY item_id")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _anchor_scores(spark, sf_dir).groupBy("item_id").agg(F.collect_list("c").alias("cs"))
    return g.select("item_id", F.round(N.top_mean(F.col("cs"), 2), 6).alias("top"))


@query("r11_category", f"""
    SELECT item_id, CASE WHEN source_id = 'src3' THEN 'games' WHEN b.anchor_id IS NOT NULL THEN CASE b.anchor_id WHEN 0 THEN 'ai_product' WHEN 1 THEN 'ideas_science' ELSE 'culture' END
      ELSE coalesce(p.category, 'other') END AS category
    FROM items LEFT JOIN (SELECT item_id, arg_max(anchor_id, c) AS anchor_id FROM ({_SIMS}) WHERE NOT avoid GROUP BY item_id) b USING (item_id)
    LEFT JOIN (SELECT source_id, category FROM (SELECT source_id, category, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, category) AS rn
      FROM items WHERE category <> 'other' GROUP BY source_id, category) WHERE rn = 1) p USING (source_id)""")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's forced category, else that of the best anchor, else the source's top prior (here: its most frequent category), else other."""
    best = _anchor_scores(spark, sf_dir).groupBy("item_id").agg(F.max_by("anchor_id", "c").alias("anchor_id"))
    of_anchor = F.when(F.col("anchor_id") == 0, "ai_product").when(F.col("anchor_id") == 1, "ideas_science").when(F.col("anchor_id").isNotNull(), "culture")
    forced = F.when(F.col("source_id") == "src3", "games")
    counts = _items(spark, sf_dir).where("category <> 'other'").groupBy("source_id", "category").agg(F.count("*").alias("n"))
    top = counts.groupBy("source_id").agg(F.min(F.struct(-F.col("n"), F.col("category").alias("prior")))["prior"].alias("prior"))
    return (_items(spark, sf_dir).drop("category").join(best, "item_id", "left").join(top, "source_id", "left")
            .select("item_id", F.coalesce(forced, of_anchor, F.col("prior"), F.lit("other")).alias("category")))
