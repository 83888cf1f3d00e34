"""Rules, free score, bands and feed scores: one projection each, every component kept as a column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.functions import numbers as N
from loomrank.functions import text as X

# Patterns, weights and curves of the shipped configuration, matched without regard to case.
TITLE_PATTERNS = [
    r"^sponsored[:\s]", r"^\[sponsored\]", r"^ad[:\s]", r"^advertisement\b", r"\bpaid partnership\b", r"^job[s]? (board|listing|alert)", r"^hiring[:\s]",
    r"^we['’]re hiring\b", r"^now hiring\b", r"^(weekly|daily|monthly) (deals|discounts|sale)\b", r"^deals?[:\s].*\b(off|discount|sale)\b", r"\bgiveaway\b",
    r"^open thread\b", r"^comments? of the (week|day)\b",
]
URL_PATTERNS = ["/sponsored/", "/advertorial/", "/jobs?/", "/careers?/", "/deals?/", "utm_medium=paid"]
CATEGORY_BLOCKLIST = ["sponsored", "advertisement", "jobs", "careers", "deals", "press release", "press releases", "promotions"]
PAYWALL_HOSTS = ["bloomberg.com", "wsj.com", "ft.com", "nytimes.com", "washingtonpost.com", "economist.com", "theinformation.com", "theatlantic.com", "newyorker.com"]
TYPE_PATTERNS = {
    "listicle": [r"^\d+\s+(best|worst|things|ways|tips|reasons)", r"\b(top|best)\s+\d+\b"],
    "announcement": [r"\bannounce[sd]?\b", r"\bunveil(s|ed)?\b", r"\blaunche[sd]\b", r"\bnow available\b", r"\bintroducing\b", r"\bpartners? with\b", r"\braises? \$",
                     r"\bfunding round\b", r"\bappoints?\b"],
    "news": [r"\breport(s|ed)?\b", r"\bsays\b", r"\baccording to\b", r"\bconfirm(s|ed)\b", r"\bbreaking\b"],
    "interview": [r"\binterview\b", r"\bin conversation with\b", r"\ba conversation with\b", r"\bQ&A\b"],
    "review": [r"\breview\b", r"\bhands[- ]on\b", r"\bfirst impressions\b"],
    "criticism": [r"\bcriticism\b", r"\bclose reading\b", r"\bon the design of\b", r"\bwhat .* gets (right|wrong)\b"],
    "history": [r"\bhistory of\b", r"\bin \d{4}\b", r"\barchive\b", r"\boral history\b", r"\bthe making of\b", r"\bpart \d+\b"],
    "explainer": [r"\bhow (does|do|to)\b", r"\bwhy (does|do|is|are)\b", r"\bexplained\b", r"\bwhat is\b", r"\ba guide to\b"],
    "essay": [r"\bessay\b", r"\bnotes on\b", r"\bagainst\b", r"\bin praise of\b", r"\bon being\b"],
    "analysis": [r"\banalysis\b", r"\bwhat it means\b", r"\bimplications\b", r"\blessons\b", r"\bteardown\b", r"\bdeep dive\b"],
}
TYPE_SCORES = {"analysis": .90, "essay": .90, "criticism": .88, "explainer": .85, "interview": .70, "history": .85, "review": .65,
               "linkblog": .60, "news": .40, "announcement": .30, "listicle": .20, "unknown": .55}
CURVES = {"news": (1.0, 5, .05), "announcement": (3.0, 21, .10), "review": (14.0, None, .30), "interview": (21.0, None, .35), "analysis": (21.0, None, .40),
          "explainer": (45.0, None, .55), "essay": (90.0, None, .65), "criticism": (90.0, None, .65), "history": (365.0, None, .80),
          "listicle": (2.0, 10, .05), "linkblog": (5.0, 30, .20), "unknown": (14.0, None, .30)}
CLICKBAIT = [r"\byou won['’]t believe\b", r"\bthis is why\b", r"\bwhat happened next\b", r"\bgoes viral\b", r"\bslams?\b", r"\bdestroys?\b", r"\bshocking\b", r"\bfurious\b",
             r"\beveryone is\b", r"\bnobody is talking about\b", r"\bthe real reason\b", r"\?!+$"]
WEIGHTS = {"quality": .12, "category": .06, "keyword": .09, "semantic": .38, "freshness": .13, "type": .17, "discovery": .05}
PENALTIES = {"volume": .15, "redundancy": .20, "clickbait": .20, "negative": .25}
VOLUME_DECAY, VOLUME_TAIL = [1.0, .92, .82, .68, .50, .36, .25], .18
BANDS = ((.396, "A"), (.299, "B"), (.242, "C"))
#: From this cosine on an item is a near copy of another.
NEAR_COPY = .94


def matches(s: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches, without regard to case; one pass over s, in which patterns that begin with a word's first letter are tried there only, by that letter."""
    parts, starts = [], {}
    for p in patterns:
        # an alternative outside groups would leave the start behind
        if re.match(r"\\b[A-Za-z](?![?*+{])", p) and "|" not in re.sub(r"(?<!\\)\([^()\[\]\\]*\)", "", p):
            starts.setdefault(p[2].lower(), []).append(p[3:])
        else:
            parts.append(f"(?:{p})")
    if starts:
        parts.append(r"\b(?:" + "|".join(f"{c}(?:{'|'.join(rests)})" for c, rests in starts.items()) + ")")
    return s.rlike("(?i)" + "|".join(parts))


def first_match(s: Column, patterns: list[str]) -> Column:
    """The first pattern, in list order, that s matches without regard to case; else null. Most texts match none, which one pass tells."""
    return F.when(matches(s, patterns), F.coalesce(*[F.when(s.rlike("(?i)" + p), F.lit(p)) for p in patterns]))


def host_in(host: Column, hosts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))


def blocked_category(cats: Column, blocked: list[str]) -> Column:
    return F.arrays_overlap(F.transform(cats, F.lower), F.array(*map(F.lit, blocked)))


def lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def text_type(title: Column, summary: Column) -> Column:
    """The first type, in order, with a matching pattern; else null. Most texts match none, which one pass tells."""
    hay = F.concat_ws(" ", title, F.lit(""), F.substring(F.coalesce(summary, F.lit("")), 1, 400))
    typed = F.coalesce(*[F.when(matches(hay, ps), F.lit(t)) for t, ps in TYPE_PATTERNS.items()])
    return F.when(matches(hay, [p for ps in TYPE_PATTERNS.values() for p in ps]), typed)


def editorial_type(title: Column, summary: Column, feed_type: Column) -> Column:
    """The first type, in order, with a matching pattern; a link blog's items are linkblog; else unknown."""
    return known_type(text_type(title, summary), feed_type)


def known_type(typed: Column, feed_type: Column) -> Column:
    return F.coalesce(typed, F.when(feed_type == "linkblog", F.lit("linkblog")), F.lit("unknown"))


def expired(published: Column, kind: Column, now: int) -> Column:
    days = lookup(kind, {k: c[1] for k, c in CURVES.items() if c[1]}, None)
    return F.coalesce((F.lit(now) - published) > days.cast("long") * N.DAY, F.lit(False))


def rule_filter(items: DataFrame, now: int, allowed: tuple[str, ...] = ("en",), max_age_days: int = 14) -> DataFrame:
    """items with thin, keep, matched_rule: the first rule of the ladder that matches decides.

    items: title, summary, url, host, categories, language, access, is_podcast, publication_time, feed_type.
    """
    title = F.trim(F.coalesce("title", F.lit("")))
    words = X.language_verdict(F.concat_ws(" ", "title", "summary"), F.col("language"))
    ranked = items.withColumns({"_lang": words, "_type": editorial_type(F.col("title"), F.col("summary"), F.col("feed_type")),
                                "_title": first_match(title, TITLE_PATTERNS), "_url": first_match(F.col("url"), URL_PATTERNS)})
    rule = (F.when(F.col("access") != "free", F.concat(F.lit("access:"), F.col("access")))
            .when(F.col("is_podcast"), "drop_podcast_items")
            .when((title == "") & F.col("url").isNull(), "malformed")
            .when((F.length(title) < 8) & (title != "") & F.col("url").isNull(), "min_title_length")
            .when(F.col("_title").isNotNull(), F.col("_title"))
            .when(host_in(F.col("host"), PAYWALL_HOSTS), "paywall_host")
            .when(~F.coalesce(F.col("_lang.language").isin(*allowed) & (F.col("_lang.verdict") != "uncertain"), F.lit(False)),
                  F.when(F.col("_lang.language").isNotNull(), "allowed_languages").otherwise("allowed_languages_uncertain"))
            .when(F.col("_url").isNotNull(), F.col("_url"))
            .when(blocked_category(F.col("categories"), CATEGORY_BLOCKLIST), "feed_category")
            .when(F.col("publication_time") < F.lit(now) - F.lit(max_age_days).cast("long") * N.DAY, "max_item_age_days")
            .when(expired(F.col("publication_time"), F.col("_type"), now), F.concat(F.lit("expires_after_days:"), F.col("_type"))))
    return (ranked.withColumn("thin", F.length(F.coalesce("summary", F.lit(""))) < 120)
            .withColumn("matched_rule", rule).withColumn("keep", F.col("matched_rule").isNull()).drop("_lang", "_type", "_title", "_url"))


def keyword_interest(title: Column, body: Column, interests: list[str], saturation: int = 3, title_weight: float = 2.0,
                     body_weight: float = 1.0, partial: float = 0.6) -> Column:
    """Words count 2 in the title, else 1 in the body; phrases as such, or at 0.6 where all their words stand apart."""
    return _lower_interest(F.lower(title), F.lower(body), interests, saturation, title_weight, body_weight, partial)


def _lower_interest(title: Column, body: Column, interests: list[str], saturation: int = 3, title_weight: float = 2.0,
                    body_weight: float = 1.0, partial: float = 0.6) -> Column:
    """keyword_interest() of texts in lower case."""
    total = F.lit(0.0)
    for interest in map(str.lower, interests):
        words = [w for w in interest.split() if len(w) > 1]
        if " " not in interest:
            total = total + F.when(X.contains_word(title, interest), title_weight).when(X.contains_word(body, interest), body_weight).otherwise(0.0)
            continue
        every = lambda s: reduce(Column.__and__, [X.contains_word(s, w) for w in words], F.lit(True))  # noqa: B023, E731
        total = total + (F.when(title.contains(interest), title_weight).when(body.contains(interest), body_weight)
                         .when(every(title), title_weight * partial).when(every(body), body_weight * partial).otherwise(0.0))
    return F.least(F.lit(1.0), total / (saturation * title_weight))


def clickbait(title: Column) -> Column:
    hits = sum((F.when(title.rlike("(?i)" + p), 1).otherwise(0) for p in CLICKBAIT), F.lit(0))
    return F.when(matches(title, CLICKBAIT), F.least(F.lit(1.0), hits * F.lit(0.35))).otherwise(0.0)


def volume_penalty(rank: Column, budget: Column) -> Column:
    index = F.floor((rank - 1) / F.greatest(F.lit(0.2), budget))
    return F.when(rank <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - N.decay_at(VOLUME_DECAY, VOLUME_TAIL, index)))


def redundancy(nearest: Column, redundant: Column, uniqueness: Column) -> Column:
    return F.when(nearest >= NEAR_COPY, F.lit(1.0)).when(redundant, 0.45 * (1 - 0.5 * uniqueness)).otherwise(0.0)


def exploring_quality(prior: Column, seen: Column, floor: Column) -> Column:
    lifted = prior + 0.6 * (F.greatest(prior, 0.5 + floor) - prior)
    return F.when(seen >= 25, prior).otherwise(N.clamp(lifted))


def band(score: Column) -> Column:
    out = F.lit("D")
    for low, name in reversed(BANDS):
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def text_parts(items: DataFrame, interests: list[str]) -> DataFrame:
    """items with text_type, c_keyword and p_clickbait in place of title and summary: all that the free score takes from the texts, so that they needn't travel through its joins and ranks."""
    lower = items.withColumns({"_title": F.lower("title"), "_body": F.lower("summary")})
    return lower.withColumns({"text_type": text_type(F.col("title"), F.col("summary")), "c_keyword": _lower_interest(F.col("_title"), F.col("_body"), interests),
                              "p_clickbait": clickbait(F.col("title"))}).drop("title", "summary", "_title", "_body")


def free_score(items: DataFrame, now: int, interests: list[str]) -> DataFrame:
    """items with the components, free_score and band.

    Ranks need a provisional score: the positive part without the penalties that ranks decide. Items that text_parts() has read keep its columns.
    items: item_id, source_id, cluster_id, title, summary, publication_time, first_seen_at, feed_type, quality_prior, exploration_floor,
    volume_budget, category_prior, anchor_mean, avoid, nearest, uniqueness, discovery, items_seen; anchor_mean null without a vector.
    """
    age = (F.lit(now) - F.coalesce("publication_time", "first_seen_at")) / F.lit(float(N.DAY))
    if "text_type" not in items.columns:
        items = text_parts(items, interests)
    typed = items.withColumn("editorial_type", known_type(F.col("text_type"), F.col("feed_type"))).drop("text_type")
    half = lookup(F.col("editorial_type"), {k: c[0] for k, c in CURVES.items()}, 14.0)
    floor = lookup(F.col("editorial_type"), {k: c[2] for k, c in CURVES.items()}, .30)
    parts = typed.withColumns({
        "c_quality": exploring_quality(F.col("quality_prior"), F.col("items_seen"), F.col("exploration_floor")),
        "c_category": F.coalesce("category_prior", F.lit(0.45)),
        "c_semantic": F.when(F.col("anchor_mean").isNotNull(), N.rescale(F.col("anchor_mean"), .10, .55)).otherwise(0.0),
        "c_freshness": N.half_life(age, half, floor),
        "c_type": lookup(F.col("editorial_type"), TYPE_SCORES, .55),
        "c_discovery": N.clamp(F.coalesce("discovery", F.lit(0.5))),
        "p_negative": F.when(F.col("anchor_mean").isNotNull(), N.rescale(F.col("avoid"), .15, .50)).otherwise(0.0),
    })
    known = F.when(F.col("anchor_mean").isNotNull(), sum(WEIGHTS.values())).otherwise(sum(WEIGHTS.values()) - WEIGHTS["semantic"])
    positive = sum((w * F.col(f"c_{k}") for k, w in WEIGHTS.items()), F.lit(0.0)) / known
    ranked = (parts.withColumn("positive", positive)
              .withColumn("provisional", F.round(F.col("positive") - PENALTIES["clickbait"] * F.col("p_clickbait") - PENALTIES["negative"] * F.col("p_negative"), 9))
              .withColumn("rank_in_run", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("provisional"), F.desc("first_seen_at"), "item_id")))
              .withColumn("redundant", F.max("provisional").over(Window.partitionBy("cluster_id")) > F.col("provisional")))
    return (ranked.withColumns({"p_volume": volume_penalty(F.col("rank_in_run"), F.col("volume_budget")),
                                "p_redundancy": redundancy(F.col("nearest"), F.col("redundant"), F.col("uniqueness"))})
            .withColumn("free_score", N.clamp(F.col("positive") - sum((w * F.col(f"p_{k}") for k, w in PENALTIES.items()), F.lit(0.0))))
            .withColumn("band", band(F.col("free_score"))))


def feed_score(weights: dict[str, float]) -> Column:
    """Weighted sum over the dimensions, normalised by the positive weights."""
    total = sum((w * F.coalesce(F.col(k), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    return total / sum(w for w in weights.values() if w > 0)


def serendipity(quality: Column, novelty: Column, surprise: Column, distance: Column, a: float = 1.0, b: float = 1.0) -> Column:
    return quality * F.pow(F.greatest(F.lit(0.0), F.greatest(novelty, surprise)), F.lit(a)) * F.pow(F.greatest(F.lit(0.0), distance), F.lit(b))


def gates(limits: dict[str, float]) -> Column:
    """The first limit that fails, in the dictionary's order; null if none does. Keys are min_ or max_ and the dimension."""
    fails = [F.when(F.col(k[4:]) > v if k.startswith("max_") else F.col(k[4:]) < v, F.lit(k)) for k, v in limits.items()]
    return F.coalesce(*fails)


def triage_gate(d: DataFrame) -> DataFrame:
    """d with gate_score, threshold, passed: bypass for serendipity, audits always, DROP never, else the discounted threshold."""
    score = (.35 * F.col("free_score") + .45 * F.col("interest") + .25 * F.col("novelty") + .12 * F.col("quality_prior") - 1.2 * F.col("junk_probability"))
    cut = (lookup(F.col("category"), {"ideas_science": .44, "culture": .46, "games": .50, "ai_product": .55}, .50)
           - F.when(F.col("action") == "UNCERTAIN", .10).otherwise(0.0) - F.when(F.col("quality_prior") >= .78, .12).otherwise(0.0)
           - F.when(F.col("band") == "A", .06).otherwise(0.0))
    passed = (F.when((F.col("distance") >= .55) & (F.col("novelty") >= .55) & (F.col("junk_probability") <= .35), True)
              .when(F.col("is_audit_sample"), True).when(F.col("action") == "DROP", False).otherwise(F.col("gate_score") >= F.col("threshold")))
    return d.withColumns({"gate_score": score, "threshold": cut}).withColumn("passed", passed)


def attention(words: Column, extracted: Column, model: Column, enclosure: Column, default: float = 8.0) -> Column:
    return (F.when(words > 200, F.greatest(F.lit(1.0), F.floor(words / 230 + 0.5).cast("double"))).when(extracted > 0, extracted)
            .when(model > 0, model).when(enclosure > 0, enclosure).otherwise(default))


def opportunity(d: DataFrame) -> DataFrame:
    """d with the ledger-free opportunity score of an evaluation: weighted components, junk, bonus for uncertainty, full feeds."""
    raw = (.30 * F.col("interest") + .16 * F.col("novelty") + .08 * F.least(F.lit(1.0), F.abs("triage_score")) + .14 * F.greatest(F.lit(0.0), F.col("free_score"))
           + .10 * F.col("quality_prior") + .10 * F.col("differentiation") + .08 * F.col("feed_need") + .04 * F.col("serendipity_potential")
           - .5 * F.col("junk_probability") + F.when(F.col("action") == "UNCERTAIN", .10).otherwise(0.0))
    return d.withColumn("opportunity", N.clamp(raw * F.when(F.col("feed_need") <= 0.01, .55).otherwise(1.0)))


def quality_mean(weights: dict[str, float]) -> Column:
    """Weighted mean over the dimensions a feed declares; those that an item lacks don't count, and without any the mean is 0."""
    total = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(w * F.col(k), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0)) / total).otherwise(0.0)


def feed_verdict(weights: dict[str, float], limits: dict[str, float], least: float, serendipity_of: dict[str, float] | None = None) -> dict[str, Column]:
    """Columns v (the feed's score: weighted, or quality x novelty x distance in serendipity mode), admitted and reason. Gates come before the smallest score."""
    if serendipity_of:
        score = serendipity(quality_mean(serendipity_of), F.col("novelty"), F.lit(0.0), F.col("anchor_distance"))
    else:
        score = feed_score(weights)
    score = F.round(score, 6)
    names = {"distance": "anchor_distance"}
    fails = [F.when(F.col(names.get(k[4:], k[4:])) > v if k.startswith("max_") else F.col(names.get(k[4:], k[4:])) < v, F.lit(k)) for k, v in limits.items()]
    gate = F.coalesce(*fails)
    reason = F.when(gate.isNotNull(), F.concat(F.lit("gate:"), gate)).when(score < least, "below_min_score").otherwise("ok")
    return {"v": score, "admitted": gate.isNull() & (score >= least), "reason": reason}


def slots_and_audits(ranked: DataFrame, slots: int, audit_cap: int, rates: tuple[tuple[str, float], ...] = (("C", .06), ("D", .01))) -> DataFrame:
    """ranked(item_id, free_score, band) with selected, audit and reason: bands A and B take slots in score order, audits are a capped hash sample of the other bands.

    Only the best `slots` of one set and `audit_cap` of the other are ever ordered (top-k, merged from each partition); nothing is windowed over the whole table.
    """
    order = [F.desc("free_score"), F.asc("item_id")]
    rate = F.lit(0.0)
    for name, share in rates:
        rate = F.when(F.col("band") == name, share).otherwise(rate)
    taken = ranked.where(F.col("band").isin("A", "B")).orderBy(*order).limit(slots).select(F.col("item_id").alias("_s"))
    audits = (ranked.where(N.hash_unit(F.concat(F.lit("audit:"), F.col("item_id"))) < rate).orderBy(*order).limit(audit_cap).select(F.col("item_id").alias("_a")))
    out = ranked.join(F.broadcast(taken), F.col("item_id") == F.col("_s"), "left").join(F.broadcast(audits), F.col("item_id") == F.col("_a"), "left")
    reason = (F.when(F.col("_s").isNotNull(), F.concat(F.lit("band_"), F.lower("band"))).when(F.col("band").isin("A", "B"), "no_slot_left")
              .when(F.col("_a").isNotNull(), "audit").otherwise(F.concat(F.lit("below_band:"), F.col("band"))))
    return out.withColumns({"selected": F.col("_s").isNotNull(), "audit": F.col("_a").isNotNull(), "reason": reason}).drop("_s", "_a")
