"""URL functions over ASCII urls, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track; the second list matches by prefix. Two-part public suffixes.
TRACKING = (
    "ref ref_src refsrc referrer source src fbclid gclid gbraid wbraid msclkid mc_cid mc_eid igshid _hsenc _hsmi hsctatracking vero_id oly_enc_id "
    "oly_anon_id __twitter_impression guccounter cmpid smid curator triedredirect publication_id post_id isfreemail r showwelcome redirect triggershare"
).split()
TRACKING_PREFIX = ("utm_", "guce_referrer", "openemail", "open_email")
TWO_PART = ("co.uk", "org.uk", "ac.uk", "com.au", "co.nz", "co.jp")


def _parts(url: Column) -> tuple[Column, ...]:
    raw = F.trim(url)
    raw = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.rlike("(?i)^[a-z][a-z0-9+.-]*:"), raw).otherwise(F.concat(F.lit("https://"), raw))
    get = lambda k: F.regexp_extract(raw, r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    return tuple(get(k) for k in range(1, 7))


def canonical(url: Column) -> Column:
    """One spelling per article: https, lower-case host without www., no tracking parameters, sorted parameters, no trailing slash, no fragment but #!."""
    scheme, host, port, path, query, fragment = _parts(url)
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"\.$", ""), r"^www\.", "")
    key = lambda p: F.lower(F.element_at(F.split(p, "="), 1))
    tracked = lambda p: key(p).isin(*TRACKING) | F.exists(F.array(*map(F.lit, TRACKING_PREFIX)), lambda t: key(p).startswith(t))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~tracked(p))
    # by key alone; parameters of one key keep their order
    placed = F.transform(kept, lambda p, i: F.struct(F.element_at(F.split(p, "="), 1).alias("key"), i.alias("at"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("pair")))
    kept = F.array_join(F.transform(F.array_sort(placed), lambda x: x["pair"]), "&")
    path = F.regexp_replace(F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path), "/{2,}", "/")
    return F.when((scheme != "") & (host != ""), F.concat(
        F.lit("https://"), host, F.when((port != "") & (port != "443") & ~((F.lower(scheme) == "http") & (port == "80")), F.concat(F.lit(":"), port)).otherwise(""),
        F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
        F.when(fragment.startswith("!"), F.concat(F.lit("#"), fragment)).otherwise("")))


def host(url: Column) -> Column:
    return F.when(canonical(url).isNotNull(), F.regexp_extract(canonical(url), "^https://([^/:?#]+)", 1))


def domain(url: Column) -> Column:
    parts = F.split(host(url), r"\.")
    n = F.size(parts)
    last = lambda k: F.array_join(F.slice(parts, F.greatest(F.lit(1), n - k + 1), F.lit(k)), ".")
    return F.when(n <= 2, host(url)).when(last(2).isin(*TWO_PART), last(3)).otherwise(last(2))


def same_article(a: Column, b: Column) -> Column:
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def search_link(base: str, words: Column) -> Column:
    return F.concat(F.lit(base), F.replace(F.url_encode(F.substring(words, 1, 120)), F.lit("+"), F.lit("%20")))


def media_format(url: Column, kind: Column) -> Column:
    return (F.when(kind.startswith("audio") | url.rlike(r"(?i)\.(mp3|m4a|ogg)([?#]|$)"), "audio")
            .when(kind.startswith("video") | url.rlike(r"(?i)(youtube\.com|youtu\.be|vimeo\.com|\.mp4([?#]|$))"), "video").otherwise("text"))


def podcast_platform(url: Column) -> Column:
    return (F.when(url.rlike("(?i)podcasts[.]apple[.]com"), "apple").when(url.rlike("(?i)open[.]spotify[.]com"), "spotify")
            .when(url.rlike("(?i)overcast[.]fm"), "overcast").when(url.rlike("(?i)pca[.]st|pocketcasts"), "pocketcasts"))
