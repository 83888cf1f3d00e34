"""Texts made of an item and what is known about it: the deep stage's message and a feed entry's html. Column functions over nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrank.functions import text as X
from loomrank.functions import urls as U

# Labels and signs of other formats in an entry, marks of pictures that are none, and the sentences of the message.
LABELS = {"audio_version": "Listen instead", "podcast_version": "Listen instead", "companion_podcast": "Companion podcast", "video_version": "Watch instead", "transcript": "Transcript"}
NO_PICTURE = "(?i)(?:logo|avatar|favicon|icon|tracking|pixel)[._/-]"
SHORT_NOTE = ("Judge it on what is here. Do not penalise it merely for being short: the full text could not be fetched. If you cannot tell whether it is good, "
              "score expected_attention_value in the middle rather than low.")
GREY, LINE = "color:#666;font-size:0.85em", "margin:0 0 1em 0"


def _line(label: str, value: Column) -> Column:
    """`label: value`, or null where there is no value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def untrusted(kind: str, content: Column) -> Column:
    """content between marks that say what it is and how many bytes it has."""
    size = F.octet_length(content).cast("string")
    return F.concat(F.lit(f"--- BEGIN UNTRUSTED {kind.upper()} DATA ("), size, F.lit(" BYTES) ---\n"), content, F.lit(f"\n--- END UNTRUSTED {kind.upper()} DATA ---"))


def deep_message(siblings: Column, most: int = 14_000) -> Column:
    """The message about one item, of columns source_name, kind, author, title, subtitle, at (ms), url, categories (array), body, summary, extracted (boolean).

    siblings: array of structs source_id, title, gist, shown. A body of more than 200 characters is given, or its opening and closing, with its length in words.
    """
    none = F.lit(None).cast("string")
    body = F.trim("body")
    head = [
        F.concat(F.lit("Source: "), F.coalesce("source_name", F.lit(""))), F.when(F.col("kind") == "product", "Item type: product discovery card"), _line("Author", F.col("author")),
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), _line("Subtitle", F.col("subtitle")), _line("Published", F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd")), _line("URL", F.col("url")),
        _line("Suggested category", F.array_join("categories", ", "))]
    told = F.transform(siblings, lambda s: F.concat(F.lit("- "), F.coalesce(s["source_id"], F.lit("")), F.lit(": "), s["title"], F.when(F.coalesce(s["gist"], F.lit("")) != "", F.concat(F.lit(" — "), s["gist"])).otherwise(""),
                                                    F.when(s["shown"], " [already shown to the reader]").otherwise("")))
    others = F.when(F.size(siblings) > 0, F.concat(F.lit("\nOther coverage of this same story:\n"), F.array_join(told, "\n")))
    words = F.size(F.split(body, r"\s+")).cast("string")

    def long_text(x: Column) -> Column:
        title = (F.when(~F.coalesce("extracted", F.lit(False)), "--- Article text (RSS content only; the full page was not available) ---")
                 .when(x["excerpted"], "--- Article text (opening and closing; the middle is omitted for length) ---").otherwise("--- Article text ---"))
        note = F.when(x["excerpted"], F.concat(F.lit("\n(This is an excerpt of a ~"), words, F.lit("-word article; "), x["omitted"].cast("string"),
                                               F.lit(" characters from the middle are not shown. Judge it as the long piece it is.)")))
        return F.array_join(F.array(F.concat(F.lit("Article length: ~"), words, F.lit(" words.")), title, x["text"], note), "\n")

    short = F.concat(F.lit("--- Only the RSS summary is available for this item ---\n"), F.coalesce("summary", F.lit("(no summary)")), F.lit(f"\n\n{SHORT_NOTE}"))
    text = F.when(F.length(body) > 200, X.once(X.structural_excerpt(body, most), long_text)).otherwise(short)
    return untrusted("article", F.array_join(F.array(*head, others, F.lit(""), text, none), "\n"))


def format_line(format_type: Column, minutes: Column) -> Column:
    """Sign, label and length of another format."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), format_type), F.lit("Alternate version"))
    sign = F.when(format_type == "video_version", "📺").when(format_type == "transcript", "📄").otherwise("🎧")
    length = X.human_minutes(minutes)
    return F.concat(sign, F.lit(" "), label, F.when(length != "", F.concat(F.lit(" — "), length)).otherwise(""))


def item_html(alternates: Column, images: Column) -> Column:
    """An entry's html, of columns source_name, author, minutes, kind, why, summary, link, original_url, lead_image.

    alternates: array of structs format_type, url, minutes, spotify_url, best first; images: array of structs url, alt, caption, of which six are shown; without any, the lead image, unless it is a logo or the like.
    """
    e = X.escape_xml
    length = X.human_minutes(F.col("minutes"))
    meta = F.array_join(F.filter(F.array("source_name", "author", length), lambda x: F.coalesce(x, F.lit("")) != ""), " · ")
    lead = F.when(F.col("lead_image").isNotNull() & ~F.col("lead_image").rlike(NO_PICTURE), F.array(F.struct(F.col("lead_image").alias("url"), F.lit(None).cast("string").alias("alt"), F.lit(None).cast("string").alias("caption"))))
    shown = F.slice(F.coalesce(F.when(F.size(images) > 0, images), lead, F.array().cast("array<struct<url:string,alt:string,caption:string>>")), 1, 6)
    figure = lambda i: F.concat(F.lit(f'<figure style="{LINE}"><img src="'), e(i["url"]), F.lit('" alt="'), e(F.coalesce(i["alt"], i["caption"])), F.lit('" style="max-width:100%;height:auto">'),
                                F.when(F.coalesce(i["caption"], F.lit("")) != "", F.concat(F.lit(f'<figcaption style="{GREY}">'), e(i["caption"]), F.lit("</figcaption>"))).otherwise(""), F.lit("</figure>"))
    spoken = lambda a: F.when((F.coalesce(a["spotify_url"], F.lit("")) != "") & ~a["format_type"].isin("video_version", "transcript"),
                              F.concat(F.lit(' &nbsp;<a href="'), e(a["spotify_url"]), F.lit('">Find on Spotify</a>'))).otherwise("")
    other = lambda a: F.concat(F.lit(f'<p style="{LINE}"><a href="'), e(a["url"]), F.lit('"><strong>'), e(format_line(a["format_type"], a["minutes"])), F.lit("</strong></a>"), spoken(a), F.lit("</p>"))
    lines = lambda xs: F.when(F.size(xs) > 0, F.array_join(xs, "\n"))
    where = F.when(F.col("link") != F.col("original_url"), F.concat(F.lit(' <span style="color:#999;font-size:0.85em">('), e(F.coalesce(U.host(F.col("original_url")), "original_url")), F.lit(")</span>"))).otherwise("")
    parts = [
        F.concat(F.lit('<p style="color:#666;font-size:0.9em;margin:0 0 1em 0">'), e(meta), F.lit("</p>")),
        F.when(F.col("kind") == "product", f'<p style="{LINE}"><strong>Product discovery</strong></p>'), lines(F.transform(shown, figure)),
        F.when(F.coalesce("why", F.lit("")) != "", F.concat(F.lit(f'<p style="{LINE}"><strong>Why this surfaced:</strong><br>'), e(F.col("why")), F.lit("</p>"))), lines(F.transform(alternates, other)),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(f'<p style="{LINE}">'), e(X.truncate(X.collapse(F.col("summary")), 400)), F.lit("</p>"))),
        F.concat(F.lit('<p style="margin:0"><a href="'), e(F.col("link")), F.lit('">Original article</a>'))]
    return F.array_join(F.array(*parts, F.concat(where, F.lit("</p>"))), "\n")
