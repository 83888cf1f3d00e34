"""Sequential selections: editions and budgeted allocation.

Both take one candidate at a time and re-score the rest, so each pick depends on all picks before it. What does not
depend on picks (base scores, gates, admission) is computed by Spark beforehand; multipliers never exceed 1, so candidates
under the bar without picks can never be taken and are cut. Of the rest only the best of each (source, category) go to
the one task that picks, so its group is bounded by sources x categories, not by the number of items.
For allocation this bound loses nothing: within a source and category the order never changes, and no more than the affordable
calls can be bought. For editions the best of each group are handed over first; wherever a row that was held back could have come before
a pick (its score at most that of the group's last row handed over, under the multipliers of that moment), the run is repeated with four
times as many, until no such row is left. So the result is that of all candidates, and the usual case needs the small bound only.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Decay lists of the shipped configuration.
SOURCE_DECAY, SOURCE_TAIL, SOURCE_CAP = [1, .9, .75, .55, .4, .28], .2, 6
TOPIC_DECAY, TOPIC_TAIL = [1, .88, .72, .55, .42], .3
CLUSTER_DECAY, CLUSTER_TAIL, MAX_DUPLICATE = [1, .55, .25], .1, .45
CORRELATION, MAX_CORRELATION = .25, .35
BASE = {"score": 1.00, "quality_prior": .04, "feed_weight": .16, "learned": .08}


def base_value(score: Column, quality_prior: Column, learned: Column, feed_weight: Column) -> Column:
    """The feed's score with its three small adjustments, before any diminishing returns."""
    return BASE["score"] * score + BASE["quality_prior"] * (quality_prior - .5) + BASE["learned"] * learned + BASE["feed_weight"] * (feed_weight - .6)


def _at(decay: list[float], tail: float, n: int) -> float:
    return decay[n] if n < len(decay) else tail


def multiplier(row, sources: Counter, topics: Counter, stories: Counter, partners: dict[str, list[tuple[str, float]]]) -> float:
    """Diminishing returns of a candidate given what an edition already holds."""
    n = stories[row.cluster_id]
    story = _at(CLUSTER_DECAY, CLUSTER_TAIL, n)
    story = story if n == 0 else story + (1 - story) * min(1, max(0, 1 - row.duplicate_information))
    worst = max((min(MAX_CORRELATION, CORRELATION * o * sources[p]) for p, o in partners.get(row.source_id, ())), default=0)
    return _at(SOURCE_DECAY, SOURCE_TAIL, sources[row.source_id]) * _at(TOPIC_DECAY, TOPIC_TAIL, topics[row.category]) * story * (1 - worst)


def fill(rows: list, cap: int, minutes: float, category_cap: int, min_score: float, protected: int, partners: dict, used: Counter, max_feeds: int = 2, overflow: float = 10,
         missed: list | None = None) -> list[tuple]:
    """(item_id, place, value) of the picks from rows (value order; ties to the earliest): the greedy argmax under all caps.

    A row that is too long for the minutes left can't be picked any more, so only rows that fit are compared: each pick is one pass.
    Rows with `cut` set are the last of a group that has more, and `least` is the shortest of that group; missed gets those whose unseen successors could have been picked.
    """
    ends = [r for r in rows if getattr(r, "cut", False)]
    sources, topics, stories = Counter(), Counter(), Counter()
    spent, explored, picked, left, room = 0.0, 0, [], [r for r in rows if used[r.item_id] < max_feeds], minutes + overflow
    while left and len(picked) < cap:
        free = cap - len(picked)
        only_exploring = max(0, protected - explored) >= free
        best, value = None, min_score
        left = [r for r in left if not spent + r.minutes > room]
        for r in left:
            if (sources[r.source_id] >= SOURCE_CAP or topics[r.category] >= category_cap or only_exploring and not r.exploratory
                    or stories[r.cluster_id] and r.duplicate_information > MAX_DUPLICATE or r.score < value):
                continue
            v = r.score * multiplier(r, sources, topics, stories, partners)
            if v >= min_score and (best is None or v > value):
                best, value = r, v
        if missed is not None:
            for r in ends:
                open_ = sources[r.source_id] < SOURCE_CAP and topics[r.category] < category_cap and not spent + getattr(r, "least", 0) > room
                if open_ and r.score * _at(SOURCE_DECAY, SOURCE_TAIL, sources[r.source_id]) * _at(TOPIC_DECAY, TOPIC_TAIL, topics[r.category]) >= value:
                    missed.append(r.item_id)
        if best is None:
            break
        left = [r for r in left if r is not best]
        picked.append((best.item_id, len(picked) + 1, float(value)))
        spent += best.minutes
        explored += bool(best.exploratory)
        sources[best.source_id] += 1
        topics[best.category] += 1
        stories[best.cluster_id] += 1
        used[best.item_id] += 1
    return picked


def editions(candidates: DataFrame, feeds: list[dict], overlap: dict[str, list[tuple[str, float]]] | None = None, keep=lambda df: df) -> DataFrame:
    """feed, item_id, place, value; keep writes the candidates over the bar and the few picks down so that they are not worked out twice. candidates: feed, item_id, source_id, cluster_id, category, score, duplicate_information, minutes, exploratory.

    feeds, in priority order: feed, cap, minutes, category_cap, min_score, protected. They share the limit of feeds per item, so one task fills all of them.
    """
    bars = F.create_map(*[F.lit(x) for f in feeds for x in (f["feed"], float(f["min_score"]))])
    able = keep(candidates.where(F.col("score") >= bars[F.col("feed")]))
    least = able.groupBy("feed", "source_id", "category").agg(F.min("minutes").alias("least")).select(*[F.col(c).alias(f"_{c}") for c in ("feed", "source_id", "category")], "least")
    same = (F.col("feed") == F.col("_feed")) & F.col("source_id").eqNullSafe(F.col("_source_id")) & F.col("category").eqNullSafe(F.col("_category"))
    group = Window.partitionBy("feed", "source_id", "category").orderBy(F.desc("score"), "item_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out, missed = Counter(), [], []
        for f in feeds:
            rows = list(pdf[pdf["feed"] == f["feed"]].sort_values(["score", "item_id"], ascending=[False, True]).itertuples(index=False))
            out += [(f["feed"], *p) for p in fill(rows, f["cap"], f["minutes"], f["category_cap"], f["min_score"], f["protected"], overlap or {}, used, missed=missed)]
        return pd.DataFrame(out + [(None, i, -1, 0.0) for i in missed[:1]], columns=["feed", "item_id", "place", "value"])

    bound = 3 * SOURCE_CAP
    while True:
        # one row more than the bound tells whether a group has more; ranks are limited before the shuffle
        ranked = able.withColumn("_r", F.row_number().over(group)).where(F.col("_r") <= bound + 1)
        handed = ranked.withColumn("cut", (F.col("_r") == bound) & (F.lead("_r").over(group).isNotNull())).where(F.col("_r") <= bound).drop("_r").join(least, same, "left").drop("_feed", "_source_id", "_category")
        picks = keep(handed.withColumn("run", F.lit("edition")).groupBy("run").applyInPandas(run, "feed string, item_id long, place long, value double"))
        if picks.where("place < 0").isEmpty():
            return picks
        bound *= 4


def spend(rows: list, affordable: int, bar: float, reserve: int, source_penalty: float = .08, topic_penalty: float = .06) -> list[tuple]:
    """(item_id, place, score) of what a run buys: audits first up to the reserve, then the best score over the bar, re-scored after each."""
    sources, topics, audits, bought, left = Counter(), Counter(), 0, [], list(rows)

    def now(r):
        return r.opportunity - source_penalty * (1 - 1 / (1 + sources[r.source_id])) - topic_penalty * (1 - 1 / (1 + topics[r.category]))

    while left and len(bought) < affordable:
        audit = next((r for r in sorted((r for r in left if r.audit), key=lambda r: (-now(r), r.item_id))), None) if audits < reserve else None
        pick = audit or min(left, key=lambda r: (-now(r), r.item_id))
        if not pick.audit and now(pick) < bar:
            break
        bought.append((pick.item_id, len(bought) + 1, float(now(pick))))
        audits += bool(pick.audit)
        sources[pick.source_id] += 1
        topics[pick.category] += 1
        left.remove(pick)
    return bought


def allocate(candidates: DataFrame, budgets: list[tuple[str, int, float]], reserve_share: float = .1) -> DataFrame:
    """budget, item_id, place, score for each (name, affordable calls, bar): budgets run in parallel, one group each.

    candidates: item_id, source_id, category, opportunity, audit. Per (source, category) the best `affordable` are enough.
    """
    most = max(n for _, n, _ in budgets)
    w = Window.partitionBy("source_id", "category", "audit").orderBy(F.desc("opportunity"), "item_id")
    bounded = candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    spread = bounded.withColumn("budget", F.explode(F.array(*[F.lit(b) for b, _, _ in budgets])))
    limits = {b: (n, bar) for b, n, bar in budgets}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["budget"].iat[0]
        n, bar = limits[name]
        out = spend(list(pdf.itertuples(index=False)), n, bar, round(n * reserve_share))
        return pd.DataFrame([(name, *x) for x in out], columns=["budget", "item_id", "place", "score"])

    return spread.groupBy("budget").applyInPandas(run, "budget string, item_id long, place long, score double")
