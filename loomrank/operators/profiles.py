"""A reader's dossier compiled to a profile: transforms over nested columns, one row in and one row out, without an explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions import numbers as N
from loomrank.functions import text as X

# How sure a statement must be, and what a relationship to a source means for its items.
CORE_CONFIDENCE, SIGNAL_CONFIDENCE = .55, .35
RELATIONS = {"known_favorite": ("known_favorite", "direct_follow"), "positive_evidence": ("recommended", "selective"), "known_dislike": ("avoid", "direct_follow"), "noisy_but_useful": ("exploratory", "discovery_only")}
NO_CONDITIONS, NO_COVERAGE = "recommend only when the treatment is genuinely worthwhile", "normally exclude this topic"
ELSEWHERE = "Text must clear a higher quality bar because another medium is usually preferred."

INTEREST = ("struct<id:string,label:string,tier:string,confidence:double,priority:double,preferred_coverage:array<string>,avoid_coverage:array<string>,conditions:array<string>,"
            "saturation_guidance:string,repeat_tolerance:string,medium_fit:string>")


def _sentences(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def _listed(label: str, values: Column, by: str) -> Column:
    """`label values.`, or null where there are none."""
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label} "), F.array_join(values, by), F.lit(".")))


def guidance(i: Column) -> Column:
    """What is said of one interest, in sentences."""
    tolerance = F.when(i["repeat_tolerance"] != "unknown", F.concat(F.lit("Repeat tolerance: "), i["repeat_tolerance"], F.lit(".")))
    return _sentences(
        F.concat(F.replace(i["tier"], F.lit("_"), F.lit(" ")), F.lit(" interest.")), _listed("Prefer", i["preferred_coverage"], ", "), _listed("Avoid", i["avoid_coverage"], ", "),
        _listed("Conditions:", i["conditions"], "; "), F.when(F.coalesce(i["saturation_guidance"], F.lit("")) != "", i["saturation_guidance"]).otherwise(tolerance), F.when(i["medium_fit"] == "stronger_elsewhere", ELSEWHERE))


def _said(i: Column, otherwise: str) -> Column:
    told = F.array_join(F.concat(i["preferred_coverage"], i["conditions"]), "; ")
    return F.concat(i["label"], F.lit(": "), F.when(told != "", told).otherwise(otherwise))


def last_by_id(entries: Column) -> Column:
    """Entries with each id once, where it came first, with what was said last."""
    return F.transform(F.array_distinct(F.transform(entries, lambda e: e["id"])), lambda i: F.element_at(F.filter(entries, lambda e: e["id"] == i), -1))


def compile_profiles(dossiers: DataFrame, key: str) -> DataFrame:
    """key and the profile's columns, for dossiers(key, reading_goal, summary, interests, signals, anchors, avoids, sources).

    interests as INTEREST; signals: structs signal, effect, why, confidence; anchors: id, description; avoids: id, description, strength; sources: name, relationship, scope, reason, confidence.
    Priorities shrink to the neutral 5 by what the confidence lacks. Unwanted interests and disliked sources become anchors to avoid, which take the place of earlier ones of their id.
    """
    c = F.col
    trait = lambda s, tail: F.concat(F.when(s["effect"] == "hard_filter", "hard filter").otherwise(F.regexp_replace(s["effect"], tail, "")), F.lit(": "), s["signal"], F.lit(" — "), s["why"])
    sure = lambda s: s["confidence"] >= SIGNAL_CONFIDENCE
    own = F.transform(F.filter("interests", lambda i: ~i["tier"].isin("low", "unwanted")), lambda i: F.struct(i["id"].alias("id"), _said(i, NO_CONDITIONS).alias("text")))
    anchor = lambda id_, text, strength: F.struct(id_.alias("id"), text.alias("text"), strength.alias("strength"))
    avoid = F.concat(
        F.transform("avoids", lambda a: anchor(a["id"], a["description"], a["strength"])),
        F.transform(F.filter("interests", lambda i: i["tier"] == "unwanted"), lambda i: anchor(i["id"], _said(i, NO_COVERAGE), F.lit("moderate"))),
        F.transform(F.filter("sources", lambda s: s["relationship"] == "known_dislike"), lambda s: anchor(
            F.concat(F.lit("source_"), F.regexp_replace(F.lower(s["name"]), "[^a-z0-9]+", "_")), F.concat(s["name"], F.lit(": "), s["scope"]), F.lit("moderate"))))
    pick = lambda k: F.create_map(*[F.lit(x) for name, pair in RELATIONS.items() for x in (name, pair[k])])
    return dossiers.select(
        key, X.collapse(F.concat_ws(" ", F.trim("reading_goal"), F.trim("summary"))).alias("about_me"),
        F.transform(F.filter("interests", lambda i: (i["tier"] == "core") & (i["confidence"] >= CORE_CONFIDENCE)), lambda i: i["label"]).alias("strong_interests"),
        F.transform("interests", lambda i: F.struct(i["id"].alias("id"), N.shrunk_priority(i["priority"], i["confidence"]).alias("priority"), guidance(i).alias("guidance"))).alias("topic_priorities"),
        F.transform(F.filter("signals", lambda s: s["effect"].endswith("positive") & sure(s)), lambda s: trait(s, "_positive$")).alias("positive_traits"),
        F.transform(F.filter("signals", lambda s: (s["effect"].endswith("negative") | (s["effect"] == "hard_filter")) & sure(s)), lambda s: trait(s, "_negative$")).alias("negative_traits"),
        F.when(F.size("anchors") > 0, F.transform("anchors", lambda a: F.struct(a["id"].alias("id"), a["description"].alias("text")))).otherwise(own).alias("interest_anchors"),
        last_by_id(avoid).alias("avoid_anchors"),
        F.transform(F.filter("sources", lambda s: s["relationship"] == "style_reference"), lambda s: F.struct(s["name"].alias("name"), s["scope"].alias("guidance"))).alias("style_references"),
        F.transform(F.filter("sources", lambda s: s["relationship"].isin(*RELATIONS)), lambda s: F.struct(
            s["name"].alias("name"), F.element_at(pick(0), s["relationship"]).alias("disposition"), F.element_at(pick(1), s["relationship"]).alias("role"), s["reason"].alias("reason"), s["confidence"].alias("confidence"))).alias("source_preferences"))
