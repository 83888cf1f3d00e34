"""Feedback entries to published items, and articles to episodes and other formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions import numbers as N
from loomrank.functions import text as X
from loomrank.functions import urls as U
from loomrank.operators.setjoin import different_sets, set_key, similar_sets

# Title cuts, weights of an alternate format's signals, and what a match needs.
TITLE_CUT, LEAST_TITLE = .75, 12
EXPLICIT, STRUCTURED, PLAYER, MENTIONED, TITLE, PUBLISHER, SEMANTIC, NEAR = .55, .50, .35, .45, .30, .20, .30, .15
EPISODE_TITLE, EPISODE_COSINE, EPISODE_HOURS, TOO_FAR, SAME_DOMAIN, CONFIDENT = .70, .80, 96, -.25, .30, .72

#: Lengths of path starts on which urls and texts meet; a url takes the longest that it has.
STARTS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Last characters of a host: every host is at least as long.
_TAIL = 4


def title_set(title: Column) -> Column:
    return set_key(X.tokenize(title))


def match_feedback(entries: DataFrame, published: DataFrame, cut: float = TITLE_CUT) -> DataFrame:
    """entry_id, item_id, matched_by for entries(entry_id, title, link) against published(item_id, ref, title, url); unmatched entries stay, with nulls.

    First a tracked link /open/<ref>, then equal canonical urls, then the most similar title of at least 12 characters at or over the cut; equals go to the
    smallest item_id. Titles meet as different token sets, so copies on either side cost one row.
    """
    link = F.regexp_extract("link", r"/open/([A-Za-z0-9_-]{8,})", 1)
    refs = published.where("ref IS NOT NULL").groupBy(F.col("ref").alias("tracked")).agg(F.min("item_id").alias("by_ref"))
    urls = published.select("item_id", U.canonical(F.col("url")).alias("canonical")).where("canonical IS NOT NULL").groupBy("canonical").agg(F.min("item_id").alias("by_url"))
    asked = (entries.select("entry_id", link.alias("tracked"), U.canonical(F.col("link")).alias("canonical"), F.when(F.length(X.collapse(F.col("title"))) >= LEAST_TITLE, title_set(F.col("title"))).alias("key"))
             .join(refs, "tracked", "left").join(urls, "canonical", "left"))
    titles = published.select("item_id", title_set(F.col("title")).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.min("item_id").alias("item_id"))
    # entries that a link has matched need no title
    wanted = different_sets(asked.where("by_ref IS NULL AND by_url IS NULL"), "key")
    near = similar_sets(wanted, titles.select("key", F.split("key", "\x1f").alias("tokens")), cut)
    best = (near.join(titles, near["right_key"] == titles["key"]).groupBy(F.col("left_key").alias("key"))
            .agg(F.max(F.struct("jaccard", (-F.col("item_id")).alias("back"))).alias("best")).select("key", (-F.col("best.back")).alias("by_title")))
    how = F.when(F.col("by_ref").isNotNull(), "tracked_link").when(F.col("by_url").isNotNull(), "url").when(F.col("by_title").isNotNull(), "title")
    return asked.join(best, "key", "left").select("entry_id", F.coalesce("by_ref", "by_url", "by_title").alias("item_id"), how.alias("matched_by"))


def bare_url(url: Column) -> Column:
    """A url as texts mention it: no scheme, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/$", "")


def url_mentions(urls: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, text_id: the texts(text_id, text) that contain a url of urls(item_id, url), without its scheme, anywhere.

    Both sides meet on the end of the host and a start of the path, as long as the url has one (from a ladder of lengths), found at every slash of the
    text; then the whole text is searched for the whole url. Nothing that contains the url is lost. A url without a path must stand at label bounds.
    """
    bare = urls.select("item_id", bare_url(F.col("url")).alias("bare")).where("bare <> ''").distinct()
    path = F.substring_index("bare", "/", 1)
    rest = F.substring(F.col("bare"), F.length(path) + 2, F.length("bare"))
    longest = F.coalesce(*[F.when(F.length(rest) >= n, F.lit(n)) for n in reversed(STARTS)], F.lit(0))
    keyed = bare.select("item_id", "bare", F.when(F.contains("bare", F.lit("/")), F.concat(F.right(path, F.lit(_TAIL)), F.lit("/"), F.substring(rest, F.lit(1), longest))).otherwise(F.col("bare")).alias("key"))
    at_slash = F.regexp_extract_all("text", F.lit(rf"(?=([A-Za-z0-9.-]{{{_TAIL}}}/[^\s]{{0,{STARTS[-1]}}}))"), F.lit(1))
    starts = F.flatten(F.transform(F.array_distinct(at_slash), lambda s: F.transform(F.filter(F.array(*map(F.lit, (0, *STARTS))), lambda n: n <= F.length(s) - _TAIL - 1), lambda n: F.substring(s, F.lit(1), n + _TAIL + 1))))
    labels = F.flatten(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0))),
                                   lambda h: F.transform(F.sequence(F.lit(1), F.size(F.split(h, r"\.")) - 1), lambda k: F.array_join(F.slice(F.split(h, r"\."), k, F.size(F.split(h, r"\."))), "."))))
    said = texts.where(F.contains("text", F.lit("."))).select("text_id", F.explode(F.array_distinct(F.concat(starts, labels))).alias("key"))
    met = keyed.join(said, "key").select("item_id", "bare", "text_id")
    return met.join(texts.select("text_id", "text"), "text_id").where(F.contains("text", F.col("bare"))).select("item_id", "text_id").distinct()


def _cosine(a: str, b: str) -> Column:
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), N.cosine(F.col(a), F.col(b)))


def _alike(a: DataFrame, e: DataFrame) -> DataFrame:
    """item_id, episode_id, jaccard of the pairs of a(item_id, a_key, a_at, a_vector) and e(episode_id, e_key, e_at, e_vector) with similar titles, like vectors, and at most EPISODE_HOURS or an unknown time between them.

    Rows meet by title and slot of time, as wide as the window; rows without a time have a slot that meets all others.
    """
    width = EPISODE_HOURS * N.HOUR
    slot = lambda c, k=0: F.floor(F.col(c) / width).cast("long") + k
    named = lambda *slots: F.array(*[x.cast("string") for x in slots])
    a = a.where("a_key IS NOT NULL AND a_vector IS NOT NULL").withColumns(
        {"a_size": N.norm(F.col("a_vector")), "slot": F.when(F.col("a_at").isNull(), named(F.lit("any"))).otherwise(named(slot("a_at", -1), slot("a_at"), slot("a_at", 1), F.lit("none")))})
    e = e.where("e_key IS NOT NULL AND e_vector IS NOT NULL").withColumns({"e_size": N.norm(F.col("e_vector")), "slot": named(F.coalesce(slot("e_at").cast("string"), F.lit("none")), F.lit("any"))})
    near = similar_sets(different_sets(a, "a_key"), different_sets(e, "e_key"), EPISODE_TITLE)
    asked = near.join(a, near["left_key"] == a["a_key"]).withColumn("slot", F.explode("slot")).drop("left_key", "a_key")
    met = asked.join(e.withColumn("slot", F.explode("slot")).withColumnRenamed("e_key", "right_key"), ["right_key", "slot"])
    size = F.col("a_size") * F.col("e_size")
    like = F.when(size > 0, N.dot(F.col("a_vector"), F.col("e_vector")) / size) >= EPISODE_COSINE
    return met.where(F.coalesce(F.abs(F.col("a_at") - F.col("e_at")) <= width, F.lit(True)) & like).select("item_id", "episode_id", "jaccard")


def match_episodes(articles: DataFrame, episodes: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """Matches of articles(item_id, source_name, title, url, at, first_seen_at, embedding) with episodes(item_id, source_name, title, description, at, embedding)
    of at least this confidence: item_id, episode_id, the five signals, confidence.

    A pair gets over the bar only with a mention of the url or similar titles (publisher, vector and date together give .65), so those two joins
    find all candidates, and only those are scored. Without a mention, a title also needs like vectors (title, publisher and date give .65 too)
    and a date that isn't too far, so copies of a title meet only within these.
    """
    most = max(PUBLISHER + SEMANTIC + NEAR, TITLE + PUBLISHER + NEAR, TITLE + PUBLISHER + SEMANTIC + TOO_FAR)
    if least <= most:
        raise ValueError(f"a bar of {least} can be reached without a mention, or a title and like vectors; it must be over {most}")
    told = url_mentions(articles.select("item_id", "url"), episodes.select(F.col("item_id").alias("text_id"), F.col("description").alias("text"))).select("item_id", F.col("text_id").alias("episode_id"))
    a = articles.select("item_id", title_set(F.col("title")).alias("a_key"), F.coalesce("at", "first_seen_at").alias("a_at"), F.col("embedding").alias("a_vector"))
    e = episodes.select(F.col("item_id").alias("episode_id"), title_set(F.col("title")).alias("e_key"), F.col("at").alias("e_at"), F.col("embedding").alias("e_vector"))
    sets = lambda c: F.coalesce(F.split(c, "\x1f"), F.array().cast("array<string>"))
    mentioned = (told.join(a.select("item_id", "a_key"), "item_id").join(e.select("episode_id", "e_key"), "episode_id").withColumn("j", X.jaccard(sets("a_key"), sets("e_key")))
                 .select("item_id", "episode_id", F.when(F.col("j") >= EPISODE_TITLE, F.col("j")).alias("jaccard"), F.lit(True).alias("told")))
    pairs = (mentioned.unionByName(_alike(a, e).withColumn("told", F.lit(False)))
             .groupBy("item_id", "episode_id").agg(F.max("jaccard").alias("jaccard"), F.max("told").alias("told")))
    side = lambda d, p, when: d.select(F.col("item_id").alias(f"{p}_id"), X.publisher_key(F.col("source_name")).alias(f"{p}_publisher"), when.alias(f"{p}_at"), F.col("embedding").alias(f"{p}_vector"))
    wide = (pairs.join(side(articles, "a", F.coalesce("at", "first_seen_at")), F.col("item_id") == F.col("a_id"))
            .join(side(episodes, "e", F.col("at")), F.col("episode_id") == F.col("e_id")))
    hours = F.abs(F.col("a_at") - F.col("e_at")) / F.lit(float(N.HOUR))
    cosine = _cosine("a_vector", "e_vector")
    signals = {
        "url_mentioned": F.when(F.col("told"), MENTIONED).otherwise(0.0), "title_match": F.coalesce(TITLE * F.col("jaccard"), F.lit(0.0)),
        "publisher_match": F.when((F.col("a_publisher") == F.col("e_publisher")) & (F.col("a_publisher") != ""), PUBLISHER).otherwise(0.0),
        "semantic": F.when(cosine >= EPISODE_COSINE, SEMANTIC * cosine).otherwise(0.0),
        "date": F.when(hours <= EPISODE_HOURS, NEAR * (1 - hours / EPISODE_HOURS)).when(hours > EPISODE_HOURS, TOO_FAR).otherwise(0.0)}
    total = N.clamp(reduce(lambda x, y: x + y, map(F.col, signals)))
    return (wide.withColumns(signals).withColumn("confidence", total).where(F.col("confidence") >= least)
            .select("item_id", "episode_id", *signals, "confidence", (F.col("a_publisher") == F.col("e_publisher")).alias("same_publisher")))


FORMAT = "format_type string, url string, title string, publisher string, minutes double, confidence double, episode_id long"


def link_format(url: Column, kind: Column) -> Column:
    """What a link found in a page leads to."""
    return (F.when(url.rlike(r"(?i)youtube\.com|youtu\.be|vimeo\.com"), "video_version").when(url.rlike("(?i)transcript"), "transcript")
            .when((kind == "audio_tag") | url.rlike(r"(?i)\.(mp3|m4a|aac|ogg|wav)([?]|$)"), "audio_version").otherwise("podcast_version"))


def alternates(articles: DataFrame, links: DataFrame, episodes: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """The best other format of each type for each article: alternate_id, item_id, format_type, url, title, publisher, minutes, confidence, spotify_url, episode_id.

    articles as for match_episodes(), with enclosure_url, enclosure_type and minutes; links(item_id, place, url, kind, title, publisher, minutes) were found in the
    article's page; episodes as there, with url and minutes. An enclosure is certain; links count by kind, more on the article's own domain; episodes by their
    signals. Of equal confidence, the enclosure goes first, then links by place, then episodes by id.
    """
    made = lambda kind, url, title, publisher, minutes, confidence, episode, rank, place: [
        "item_id", kind.alias("format_type"), url.alias("url"), title.alias("title"), publisher.alias("publisher"), minutes.cast("double").alias("minutes"), confidence.alias("confidence"),
        episode.cast("long").alias("episode_id"), F.struct(F.lit(rank).alias("rank"), place.cast("long").alias("place")).alias("order")]
    c, none = F.col, F.lit(None)
    enclosed = articles.where(c("enclosure_type").startswith("audio/") & (c("enclosure_url") != "")).select(
        *made(F.lit("audio_version"), c("enclosure_url"), c("title"), c("source_name"), c("minutes"), F.lit(1.0), none, 0, F.lit(0)))
    own = articles.select("item_id", c("title").alias("own_title"), c("source_name").alias("own_name"), U.domain(c("url")).alias("own_domain"))
    weight = F.when(c("kind") == "structured_data", STRUCTURED).when(c("kind") == "embed", PLAYER).otherwise(EXPLICIT)
    same = F.coalesce(U.domain(c("url")) == c("own_domain"), F.lit(False))
    linked = links.join(own, "item_id").select(*made(
        link_format(c("url"), c("kind")), c("url"), F.coalesce("title", "own_title"), F.coalesce("publisher", "own_name"), c("minutes"), F.least(F.lit(1.0), weight + F.when(same, SAME_DOMAIN).otherwise(0.0)), none, 1, c("place")))
    known = episodes.select(c("item_id").alias("episode_id"), "url", "title", "source_name", "minutes")
    spoken = match_episodes(articles, episodes, least).join(known, "episode_id").select(*made(
        F.when(c("same_publisher"), "podcast_version").otherwise("companion_podcast"), c("url"), c("title"), c("source_name"), c("minutes"), c("confidence"), c("episode_id"), 2, c("episode_id")))
    every = enclosed.unionByName(linked).unionByName(spoken).where((c("url") != "") & (c("confidence") >= least))
    row = F.struct("url", "title", "publisher", "minutes", "confidence", "episode_id")
    best = every.groupBy("item_id", "format_type").agg(F.min_by(row, F.struct((-F.round("confidence", 9)).alias("by"), "order")).alias("m")).select("item_id", "format_type", "m.*")
    words = F.trim(F.concat_ws(" ", "title", "publisher"))
    return best.select(
        N.stable_id(F.lit("alt"), c("item_id"), c("format_type"), F.coalesce(U.canonical(c("url")), c("url"))).alias("alternate_id"), "item_id", "format_type", "url",
        F.substring(X.collapse(c("title")), 1, 300).alias("title"), "publisher", "minutes", "confidence", F.when(words != "", U.search_link("https://open.spotify.com/search/", words)).alias("spotify_url"), "episode_id")


def suppressed(found: DataFrame, published: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(published, items) once episodes that are another format of a published article have lost their own placements and are marked as duplicates."""
    gone = found.where("episode_id IS NOT NULL").join(published.select("item_id").distinct(), "item_id", "left_semi").select(F.col("episode_id").alias("item_id")).distinct()
    left = published.join(gone, "item_id", "left_anti")
    marked = items.join(gone.withColumn("_gone", F.lit(True)), "item_id", "left")
    status = F.when(F.col("_gone") & (F.col("status") != "published"), "skipped_duplicate").otherwise(F.col("status"))
    return left, marked.withColumn("status", status).drop("_gone")
