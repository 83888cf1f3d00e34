"""Feed documents, page bodies, robots rules and model output: parsing inside Arrow batches, one small helper per document."""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions import text as X

ITEM = "guid string, title string, link string, summary string, published string, author string, enclosure_url string, enclosure_type string, categories array<string>"


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def salvage(doc: str) -> str:
    """A truncated document, cut after its last whole item and closed again."""
    for end, close in (("</item>", "</channel></rss>"), ("</entry>", "</feed>")):
        if end in doc and not re.search(r"</(rss|feed|rdf:rdf)>\s*$", doc, re.I):
            root = re.search(r"<(rdf:RDF)\b", doc)
            return doc[:doc.rindex(end) + len(end)] + ("</rdf:RDF>" if root else close)
    return doc


def parse_feed(doc: str | None) -> list[dict]:
    """Items of an RSS 2.0, RDF or Atom document; an unreadable document has none."""
    if not isinstance(doc, str):
        return []
    try:
        root = ElementTree.fromstring(salvage(doc.strip()))
    except ElementTree.ParseError:
        return []
    out = []
    for node in root.iter():
        if _name(node.tag) not in ("item", "entry"):
            continue
        got: dict[str, list] = {}
        for child in node:
            got.setdefault(_name(child.tag), []).append(child)
        def text(*names, got=got):
            return next(("".join(x.itertext()).strip() for n in names for x in got.get(n, ()) if "".join(x.itertext()).strip()), None)
        links = got.get("link", [])
        link = next((x.get("href") for x in links if x.get("href") and x.get("rel", "alternate") == "alternate"), None) or text("link")
        media = [*got.get("enclosure", []), *[x for x in links if x.get("rel") == "enclosure"], *[x for x in got.get("content", []) if (x.get("type") or "").startswith(("audio", "video"))]]
        out.append({
            "guid": text("guid", "id"), "title": text("title"), "link": link, "summary": text("description", "summary", "encoded", "content"),
            "published": text("pubdate", "published", "updated", "date"), "author": text("creator", "author"),
            "enclosure_url": next((x.get("url") or x.get("href") for x in media), None), "enclosure_type": next((x.get("type") for x in media), None),
            "categories": [x.get("term") or (x.text or "").strip() for x in got.get("category", [])]})
    return out


def feed_items(docs: DataFrame) -> DataFrame:
    """One row per item of docs(source_id, body): documents fan out inside their partition."""
    def run(batches):
        for pdf in batches:
            rows = [{"source_id": s, **item} for s, body in zip(pdf["source_id"], pdf["body"], strict=True) for item in parse_feed(body)]
            yield pd.DataFrame(rows, columns=["source_id", *[c.split()[0] for c in ITEM.split(", ")]])

    return docs.select("source_id", "body").mapInPandas(run, f"source_id string, {ITEM}")


def article(html: Column) -> Column:
    """Inner text of the page's article element, else of its body: tags away, white space collapsed."""
    part = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.when(part != "", part).otherwise(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1))
    for drop in (r"(?is)<(script|style|nav|aside|footer)[^>]*>.*?</\1>", r"(?s)<!--.*?-->", r"<[^>]+>"):
        body = F.regexp_replace(body, drop, " ")
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def readable(html: Column, summary: Column, least: int = 200) -> Column:
    """Struct (text, method): the page's article if it has `least` characters, else the feed's summary, else whatever the page gave."""
    return X.once(article(html), lambda a: F.when(F.length(a) >= least, F.struct(a.alias("text"), F.lit("page").alias("method")))
                  .when(F.length(F.trim(F.coalesce(summary, F.lit("")))) > F.coalesce(F.length(a), F.lit(0)), F.struct(F.trim(summary).alias("text"), F.lit("rss").alias("method")))
                  .otherwise(F.struct(F.coalesce(a, F.lit("")).alias("text"), F.lit("page_short").alias("method"))))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


# Fixed value: words in the address of an image that is no picture.
NO_PICTURE = r"(?i)(?:^|[/_\-.])(tracking|tracker|pixel|beacon|spacer|avatar|author|logo|icon)(?:[/_\-.]|$)"


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, quoted in either way or bare; null where it is absent or empty."""
    form = rf"""(?i)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    value = F.concat(*[F.regexp_extract(tag, form, k) for k in (1, 2, 3)])
    return F.when(value != "", value)


def images(html: Column, most: int = 8) -> Column:
    """Structs url, alt, width, height of a page's images, each address once, at most `most`.

    The address is src, else one of the lazy forms, else the last of a srcset; only http(s) counts. Images of 32 pixels or less either way, trackers, logos and the like are left out.
    """
    def image(tag: Column) -> Column:
        last = F.regexp_extract(F.coalesce(_attribute(tag, "srcset"), _attribute(tag, "data-srcset")), r"(?:^|,)\s*([^,\s]+)[^,]*$", 1)
        side = lambda name: F.when(_attribute(tag, name).try_cast("double") > 0, _attribute(tag, name).try_cast("double"))
        return F.struct(F.coalesce(_attribute(tag, "src"), _attribute(tag, "data-src"), _attribute(tag, "data-original"), last).alias("url"), _attribute(tag, "alt").alias("alt"), side("width").alias("width"), side("height").alias("height"))

    found = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<img\b[^>]*>"), F.lit(0)), image)
    small = lambda x: (F.coalesce(x["width"], F.lit(33.0)) <= 32) | (F.coalesce(x["height"], F.lit(33.0)) <= 32)
    good = F.filter(found, lambda x: x["url"].rlike("(?i)^https?://") & ~x["url"].rlike(NO_PICTURE) & ~small(x))
    # the first of an address stays
    return X.once(good, lambda g: F.slice(F.transform(F.array_distinct(F.transform(g, lambda x: x["url"])), lambda u: F.get(F.filter(g, lambda x: x["url"] == u), 0)), 1, most))


def robots_allowed(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """paths(host, path) with allowed: the longest matching pattern decides, Allow wins ties, no match allows.

    rules(host, pattern, allow): `*` is any run of characters, `$` at the end the end; an empty pattern matches nothing. A host's rules are put in order
    once, as one array (a robots file), so each path meets one row and stops at the first rule that fits.
    """
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+?^(){}|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\$(?=.)", r"\\\$")
    rule = F.struct((-F.length("pattern")).alias("by"), (~F.col("allow")).alias("later"), F.concat(F.lit("^"), pattern).alias("re"), "allow")
    files = rules.where("pattern <> ''").groupBy(F.col("host").alias("h")).agg(F.array_sort(F.collect_set(rule)).alias("rules"))
    first = F.get(F.filter("rules", lambda r: F.regexp_like(F.col("path"), r["re"])), 0)["allow"]
    return paths.join(files, F.col("host") == F.col("h"), "left").select("host", "path", F.coalesce(first, F.lit(True)).alias("allowed"))


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a model's answer, strings respected; unclosed braces are closed."""
    if not isinstance(text, str) or "{" not in text:
        return None
    start, depth, quoted, skip = text.index("{"), 0, False, False
    for i, c in enumerate(text[start:], start):
        if skip:
            skip = False
        elif c == "\\":
            skip = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start:i + 1]
    return text[start:] + '"' * quoted + "}" * depth


def walk(node, depth: int = 8):
    """All objects inside a JSON value, down to `depth` levels."""
    if depth < 0:
        return
    if isinstance(node, list):
        for x in node:
            yield from walk(x, depth)
    elif isinstance(node, dict):
        yield node
        for x in node.values():
            yield from walk(x, depth - 1)


def free_to_read(raw: str | None) -> bool | None:
    """isAccessibleForFree of JSON-LD: articles' own values before others, false before true."""
    try:
        nodes = list(walk(json.loads(raw or "null")))
    except ValueError:
        return None
    values = [(0 if "Article" in str(n.get("@type")) else 1, str(n["isAccessibleForFree"]).lower() not in ("false", "0", "no")) for n in nodes if "isAccessibleForFree" in n]
    return min(values)[1] if values else None


def _per_value(f, kind: str):
    return F.pandas_udf(lambda s: s.map(lambda x: f(x) if isinstance(x, str) else None).astype(object), kind)


def json_object(text: Column) -> Column:
    return _per_value(first_object, "string")(text)


def accessible(json_ld: Column) -> Column:
    return _per_value(free_to_read, "boolean")(json_ld)


def absolute(base: Column, href: Column) -> Column:
    return F.pandas_udf(lambda b, h: pd.Series([urljoin(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(b, h, strict=True)], dtype=object), "string")(base, href)
