"""RSS, RDF and Atom documents to items with Spark's own XML reader, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions import text as X

# Names under which feeds give a field, in the order in which they are looked for, and the namespaces of their prefixes.
TITLE = ("title", "itunes:title")
SUMMARY = ("description", "summary", "itunes:summary", "itunes:subtitle", "media:description")
CONTENT = ("content:encoded", "content", "contentEncoded")
PUBLISHED = ("pubDate", "published", "dc:date", "updated", "lastBuildDate", "date")
AUTHOR = ("dc:creator", "author", "itunes:author", "creator")
GUID = ("guid", "id", "atom:id")
DURATION = ("itunes:duration", "duration")
NAMESPACES = {
    "itunes": "http://www.itunes.com/dtds/podcast-1.0.dtd", "content": "http://purl.org/rss/1.0/modules/content/", "media": "http://search.yahoo.com/mrss/",
    "dc": "http://purl.org/dc/elements/1.1/", "atom": "http://www.w3.org/2005/Atom", "slash": "http://purl.org/rss/1.0/modules/slash/", "feedburner": "http://rssnamespace.org/feedburner/ext/1.0",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
}

_TEXTS = tuple(dict.fromkeys((*TITLE, *SUMMARY, *CONTENT, *PUBLISHED, *AUTHOR, *GUID, *DURATION, "feedburner:origLink", "language", "dc:language", "itunes:episode", "itunes:season")))
_LINK = "array<struct<_VALUE: string, `@href`: string, `@rel`: string, `@type`: string, `@length`: string>>"
_MEDIA = "array<struct<_VALUE: string, `@url`: string, `@type`: string, `@medium`: string, `@width`: string, `@height`: string, `@length`: string>>"
SCHEMA = ", ".join([*(f"`{t}` string" for t in _TEXTS), f"link {_LINK}", f"enclosure {_MEDIA}", f"`media:content` {_MEDIA}", f"`media:thumbnail` {_MEDIA}",
                    "category array<struct<_VALUE: string, `@term`: string, `@label`: string>>", "`dc:subject` array<string>", "_corrupt string"])
_OPTIONS = {"attributePrefix": "@", "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreSurroundingSpaces": "true", "inferSchema": "false"}


def nodes(docs: DataFrame) -> DataFrame:
    """source_id, place, atom, node: every whole item or entry of docs(source_id, body), as a struct.

    Items are cut out of the text before parsing: a truncated document loses only the item that it breaks off in, an ill-formed item only itself
    (node._corrupt holds it), and no task parses more than one item at a time.
    """
    declared = "".join(f' xmlns:{p}="{u}"' for p, u in NAMESPACES.items())
    whole = F.regexp_extract_all("body", F.lit(r"(?s)<(?:item|entry)[\s>].*?</(?:item|entry)>"), F.lit(0))
    cut = docs.select("source_id", F.posexplode(whole).alias("place", "raw"))
    atom = cut["raw"].startswith("<entry")
    # prefixes are declared on the document's root: each item gets those of the usual modules, its own are dropped
    bare = F.regexp_replace(F.regexp_replace("raw", r"^<(item|entry)([^>]*?)\s+xmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", "<$1$2"), r"^<(item|entry)", f"<$1{declared}")
    return cut.select("source_id", "place", atom.alias("atom"), F.from_xml(bare, SCHEMA, _OPTIONS).alias("node"))


def _first(names: tuple[str, ...]) -> Column:
    """The first of these fields that is there, as trimmed text; null if it is blank."""
    value = F.coalesce(*[F.col("node").getField(n) for n in names])
    return F.when(F.trim(value) != "", F.trim(value))


def _usable(name: Column) -> Column:
    """A byline: not a number, not longer than 120 characters."""
    clean = X.collapse(name)
    return F.when((clean != "") & ~clean.rlike(r"^\d+$") & (F.length(clean) <= 120), clean)


def author() -> Column:
    """`mail (Name)` gives the name, a mail address before a name goes, an Atom author's name element counts."""
    raw = _first(AUTHOR)
    named = F.regexp_extract(raw, r"(?s)<name[^>]*>(.*?)</name>", 1)
    inner = F.regexp_extract(raw, r"\(([^)]+)\)\s*$", 1)
    return F.when(raw.contains("<"), _usable(X.decode_entities(named))).otherwise(_usable(F.when(inner != "", inner).otherwise(F.regexp_replace(raw, r"^[^\s@]+@[^\s@]+\s*", ""))))


def link() -> Column:
    """Atom: the first alternate link to html, else the first that is neither the feed itself nor an enclosure. Otherwise link, guid or original link, if absolute."""
    links = F.coalesce(F.col("node.link"), F.array().cast(_LINK.replace(": ", ":")))
    rel = lambda x: F.coalesce(x["@rel"], F.lit("alternate"))
    alternate = F.filter(links, lambda x: (x["@href"] != "") & (rel(x) == "alternate") & (F.coalesce(x["@type"], F.lit("")).isin("") | F.coalesce(x["@type"], F.lit("")).contains("html")))
    other = F.filter(links, lambda x: (x["@href"] != "") & ~rel(x).isin("self", "enclosure") | (x["@href"].isNull() & (x["_VALUE"] != "")))
    atom = F.coalesce(F.get(alternate, 0)["@href"], F.coalesce(F.get(other, 0)["@href"], F.get(other, 0)["_VALUE"]))
    said = F.coalesce(F.get(F.filter(links, lambda x: X.trimmed(x["_VALUE"]) != ""), 0)["_VALUE"], _first(("guid", "feedburner:origLink", "id")))
    said = F.trim(said)
    return F.when(F.col("atom"), atom).otherwise(F.when(said.rlike("(?i)^https?://"), said).otherwise(_first(("feedburner:origLink",))))


def enclosure() -> Column:
    """Struct url, type, length: an enclosure element, else an enclosure link, else media content if it is audio or video."""
    none = lambda kind: F.array().cast(kind.replace(": ", ":"))
    made = lambda url, kind, size: F.struct(url.alias("url"), kind.alias("type"), size.try_cast("long").alias("length"))
    enclosed = F.get(F.filter(F.coalesce(F.col("node.enclosure"), none(_MEDIA)), lambda x: F.coalesce(x["@url"], x["_VALUE"], F.lit("")) != ""), 0)
    linked = F.get(F.filter(F.coalesce(F.col("node.link"), none(_LINK)), lambda x: (x["@rel"] == "enclosure") & (x["@href"] != "")), 0)
    media = F.get(F.coalesce(F.col("node").getField("media:content"), none(_MEDIA)), 0)
    heard = media["@type"].startswith("audio/") | media["@type"].startswith("video/")
    return (F.when(enclosed.isNotNull(), made(F.coalesce(enclosed["@url"], enclosed["_VALUE"]), enclosed["@type"], enclosed["@length"]))
            .when(linked.isNotNull(), made(linked["@href"], linked["@type"], linked["@length"]))
            .when((media["@url"] != "") & heard, made(media["@url"], media["@type"], F.lit(None))))


def categories() -> Column:
    """Terms, labels and texts of categories and subjects, each once, 25 at most."""
    own = F.coalesce(F.col("node.category"), F.array().cast("array<struct<_VALUE:string,`@term`:string,`@label`:string>>"))
    every = F.concat(F.flatten(F.transform(own, lambda x: F.array(x["@term"], x["@label"], x["_VALUE"]))), F.coalesce(F.col("node").getField("dc:subject"), F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(F.transform(every, X.trimmed), lambda x: x != "")), 1, 25)


def items(docs: DataFrame) -> DataFrame:
    """One row per readable item of docs(source_id, body), with its fields; an item without title, link and summary is none."""
    duration = _first(DURATION)
    fields = nodes(docs).where("node._corrupt IS NULL").select(
        "source_id", "place", _first(GUID).alias("guid"), X.collapse(F.coalesce(_first(TITLE), F.lit(""))).alias("title"), link().alias("link"), _first(SUMMARY).alias("summary"), _first(CONTENT).alias("content"),
        _first(PUBLISHED).alias("published"), author().alias("author"), enclosure().alias("enclosure"), categories().alias("categories"), duration.alias("duration"))
    return fields.where("title <> '' OR link IS NOT NULL OR summary IS NOT NULL")
