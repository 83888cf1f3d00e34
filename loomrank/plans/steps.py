"""Single steps of the funnel as queries of their own, each with SQL written apart from the DataFrame code."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.functions import numbers as N
from loomrank.functions import text as X
from loomrank.functions import urls as U
from loomrank.operators import scoring
from loomrank.plans.analytics import _TOK, _URLSQL
from loomrank.plans.shared import ranked, ranked_within, shared_dir
from loomrank.sources import adapters
from loomrank.sources.adapters import NOW, WITH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE[name] = f, f"{WITH}\n{sql}"
        return f

    return add


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return adapters.view(spark, sf_dir, name)


@query("src10_normalise", rf"""
    SELECT item_id, canon AS canonical_url, substr(trim(regexp_replace(summary, '\s+', ' ', 'g')), 1, 2000) AS body, feed_type = 'newsletter' AS is_podcast,
      coalesce(nullif(lower(split_part(language, '-', 1)), ''), 'en') AS language
    FROM items LEFT JOIN {_URLSQL} p ON p.page_id = item_id LEFT JOIN sources USING (source_id)""")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical url, text summary of at most 2000 characters, podcast flag by feed type, the item's language else the default."""
    items, src = _view(spark, sf_dir, "items"), _view(spark, sf_dir, "sources").select("source_id", "feed_type")
    pages = spark.table("pages").select(F.col("page_id").alias("item_id"), "url")
    return (items.join(pages, "item_id", "left").join(src, "source_id", "left")
            .select("item_id", U.canonical(F.col("url")).alias("canonical_url"), F.substring(X.collapse(F.col("summary")), 1, 2000).alias("body"),
                    (F.col("feed_type") == "newsletter").alias("is_podcast"), F.coalesce(X.language_code(F.col("language")), F.lit("en")).alias("language")))


@query("w7_best_match", f"""
    WITH t AS (SELECT item_id, cluster_id, list_distinct({_TOK.format('title')}) AS t FROM items),
    p AS (SELECT a.item_id, b.item_id AS other, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE END, 6) AS conf
      FROM t a JOIN t b ON a.cluster_id = b.cluster_id AND b.item_id < a.item_id)
    SELECT item_id, other, conf FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY conf DESC, other) AS rn FROM p) WHERE rn = 1""".replace("WITH t AS", ", t AS", 1))
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the earlier one of its cluster with the most alike title; ties to the first."""
    i = _view(spark, sf_dir, "items").select("item_id", "cluster_id", F.array_distinct(X.tokenize(F.col("title"))).alias("t"))
    a, b = i.alias("a"), i.alias("b")
    pairs = (a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("b.item_id") < F.col("a.item_id")))
             .select("a.item_id", F.col("b.item_id").alias("other"), F.round(X.jaccard(F.col("a.t"), F.col("b.t")), 6).alias("conf")))
    best = pairs.groupBy("item_id").agg(F.max(F.struct("conf", -F.col("other"), "other")).alias("best"))
    return best.select("item_id", "best.other", "best.conf")


_PARTS = {"interest": .30, "novelty": .16, "triage": .08, "junk": -.5, "quality": .10}


@query("s8_top_components", """
    , c AS (SELECT item_id, unnest([{'name': 'interest', 'v': .30e0 * free_score}, {'name': 'novelty', 'v': .16e0 * triage_score}, {'name': 'triage', 'v': .08e0 * least(1e0, abs(triage_score))},
        {'name': 'junk', 'v': -.5e0 * junk_probability}, {'name': 'quality', 'v': .10e0 * quality_prior}], recursive := true)
      FROM cheap JOIN items USING (item_id) JOIN sources USING (source_id))
    SELECT item_id, name, round(v, 6) AS v, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY abs(round(v, 6)) DESC, name) AS rn FROM c WHERE abs(round(v, 6)) > 0.01e0) WHERE rn <= 3""")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three parts of an item's opportunity that weigh most, either way; parts of 0.01 or less explain nothing."""
    d = _view(spark, sf_dir, "cheap").join(_view(spark, sf_dir, "items"), "item_id").join(_view(spark, sf_dir, "sources"), "source_id")
    values = {"interest": F.col("free_score"), "novelty": F.col("triage_score"), "triage": F.least(F.lit(1.0), F.abs("triage_score")), "junk": F.col("junk_probability"), "quality": F.col("quality_prior")}
    parts = F.array(*[F.struct((-F.abs(F.round(_PARTS[k] * v, 6))).alias("by"), F.lit(k).alias("name"), F.round(_PARTS[k] * v, 6).alias("v")) for k, v in values.items()])
    top = F.slice(F.array_sort(F.filter(parts, lambda p: F.abs(p["v"]) > .01)), 1, 3)
    return d.select("item_id", F.posexplode(top).alias("at", "p")).select("item_id", "p.name", "p.v", (F.col("at") + 1).cast("long").alias("place"))


@query("d9_distinct_in_order", """
    SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's roles once, in the order in which they first speak."""
    adapters.register(spark, sf_dir)
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return (spark.table("conversations").groupBy("conv_id").agg(F.array_distinct(F.transform(turns, lambda t: t["role"])).alias("roles"))
            .select("conv_id", F.array_join("roles", ",").alias("roles")))


@query("d4_rebuild", "SELECT source_id, count(*) AS n, round(avg(free_score), 6) AS mean FROM items GROUP BY source_id")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source statistics are rebuilt by overwriting: what an earlier run left behind is gone."""
    path = f"{shared_dir(spark)}/rebuild-{uuid.uuid4().hex}"
    spark.sql("SELECT 'stale' AS source_id, 0L AS n, 0D AS mean").write.parquet(path)
    stats = _view(spark, sf_dir, "items").groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.avg("free_score"), 6).alias("mean"))
    stats.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("k7_placement_append", "SELECT feed, count(*) AS placed, count(DISTINCT item_id) AS items FROM published GROUP BY feed")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements are appended by day, as runs write them, in a folder partitioned by feed; the table is then read back."""
    path = f"{shared_dir(spark)}/placements-{uuid.uuid4().hex}"
    placed = _view(spark, sf_dir, "published")
    for half in (placed.where(F.col("published_at") < NOW - 5 * N.DAY), placed.where(F.col("published_at") >= NOW - 5 * N.DAY)):
        half.write.mode("append").partitionBy("feed").parquet(path)
    return spark.read.parquet(path).groupBy("feed").agg(F.count("*").alias("placed"), F.countDistinct("item_id").alias("items"))


@query("k8_ledger_append", "SELECT stage, model, count(*) AS calls, round(sum(cost), 6) AS cost FROM usage_ledger GROUP BY stage, model")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows are appended to the ledger stage by stage and summed from what was written."""
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    for stage in ("triage", "deep", "embedding"):
        _view(spark, sf_dir, "usage_ledger").where(F.col("stage") == stage).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("stage", "model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


@query("st6_pending_items", """
    SELECT item_id, CASE WHEN c.item_id IS NULL THEN 'triage' ELSE 'deep' END AS stage FROM items LEFT JOIN (SELECT item_id, passed FROM cheap) c USING (item_id)
    WHERE c.item_id IS NULL OR c.passed AND item_id NOT IN (SELECT item_id FROM deep)""".replace("c.item_id IS NULL", "c.passed IS NULL"))
def st6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restarted run still has to do: items without a triage decision, and passed ones without a deep evaluation."""
    items, cheap, deep = (_view(spark, sf_dir, k) for k in ("items", "cheap", "deep"))
    first = items.join(cheap, "item_id", "left_anti").select("item_id", F.lit("triage").alias("stage"))
    second = cheap.where("passed").join(deep, "item_id", "left_anti").select("item_id", F.lit("deep").alias("stage"))
    return first.unionByName(second)


@query("r29_cluster_cap", """
    , b AS (SELECT cluster_id, count(*) AS base FROM items WHERE status = 'published' GROUP BY cluster_id),
    c AS (SELECT i.item_id, i.cluster_id, i.free_score, coalesce(base, 0) AS base, coalesce(anchor_distance, 0) >= 0.55e0 AS distinct_angle, max(i.free_score) OVER g AS best,
      row_number() OVER (PARTITION BY i.cluster_id ORDER BY i.free_score DESC, i.item_id) AS rn
      FROM items i LEFT JOIN b USING (cluster_id) LEFT JOIN deep d USING (item_id) WHERE i.status <> 'published' WINDOW g AS (PARTITION BY i.cluster_id)),
    q AS (SELECT *, distinct_angle OR free_score >= 0.9e0 * best OR (rn = 1 AND base = 0) AS q FROM c)
    SELECT item_id, q AND base + count(CASE WHEN q THEN 1 END) OVER (PARTITION BY cluster_id ORDER BY free_score DESC, item_id ROWS UNBOUNDED PRECEDING) <= 3 AS allowed FROM q""")
def r29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a story at most three go to the deep stage, published ones counted: the best one, near-equals and distinct angles, in score order."""
    items, deep = _view(spark, sf_dir, "items"), _view(spark, sf_dir, "deep").select("item_id", "anchor_distance")
    base = items.where("status = 'published'").groupBy("cluster_id").agg(F.count("*").alias("base"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("free_score"), "item_id")
    d = (items.where("status <> 'published'").join(base, "cluster_id", "left").join(deep, "item_id", "left")
         .withColumns({"base": F.coalesce("base", F.lit(0)), "best": F.max("free_score").over(Window.partitionBy("cluster_id")), "rn": F.row_number().over(order)}))
    q = (F.coalesce(F.col("anchor_distance"), F.lit(0.0)) >= .55) | (F.col("free_score") >= .9 * F.col("best")) | ((F.col("rn") == 1) & (F.col("base") == 0))
    run = F.count(F.when(F.col("q"), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("q", q).select("item_id", (F.col("q") & (F.col("base") + run <= 3)).alias("allowed"))


@query("r45_audit_sampling", """
    SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY triage_score DESC, item_id) AS rn FROM cheap
      WHERE NOT passed AND (list_reduce(list_transform(string_split('turned:' || item_id, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) % 100000) / 1e5 < 0.1e0)
    WHERE rn <= 25""")
def r45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped audit of what triage turned down: a tenth by hash, the best 25 of it."""
    turned = _view(spark, sf_dir, "cheap").where(~F.col("passed") & (N.hash_unit(F.concat(F.lit("turned:"), F.col("item_id"))) < .1))
    return turned.orderBy(F.desc("triage_score"), "item_id").limit(25).select("item_id")


@query("r27_single_threshold", f"""
    , t AS (SELECT i.item_id, i.cluster_id, i.source_id, coalesce(publication_time, first_seen_at) AS at, list_distinct({_TOK.format('title')}) AS t, embedding::DOUBLE[] AS e
      FROM items i LEFT JOIN vectors v USING (item_id)),
    p AS (SELECT a.item_id, b.item_id AS other, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE END AS title,
      coalesce(list_cosine_similarity(a.e, b.e), 0) AS sim, abs(a.at - b.at) / 36e5 AS hours FROM t a JOIN t b ON a.cluster_id = b.cluster_id AND a.item_id < b.item_id)
    SELECT item_id, other, CASE WHEN hours > 96 THEN 'apart' WHEN title >= 0.62e0 THEN 'title' WHEN round(sim, 6) >= 0.845e0 THEN 'vector' ELSE 'none' END AS verdict FROM p""")
def r27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older match of two items of a cluster: outside the window nothing matches, then titles decide, then one cut on the cosine."""
    v = _view(spark, sf_dir, "vectors").select("item_id", "embedding")
    i = _view(spark, sf_dir, "items").join(v, "item_id", "left").select(
        "item_id", "cluster_id", F.coalesce("publication_time", "first_seen_at").alias("at"), F.array_distinct(X.tokenize(F.col("title"))).alias("t"), "embedding")
    a, b = i.alias("a"), i.alias("b")
    p = a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.item_id") < F.col("b.item_id")))
    sim = F.round(F.coalesce(N.cosine(F.col("a.embedding"), F.col("b.embedding")), F.lit(0.0)), 6)
    verdict = (F.when(F.abs(F.col("a.at") - F.col("b.at")) > 96 * N.HOUR, "apart").when(X.jaccard(F.col("a.t"), F.col("b.t")) >= .62, "title").when(sim >= .845, "vector").otherwise("none"))
    return p.select("a.item_id", F.col("b.item_id").alias("other"), verdict.alias("verdict"))


@query("a14_percentiles", """
    SELECT p, max(CASE WHEN rn = least(n - 1, floor(p * n / 1e2)) + 1 THEN free_score END) AS value FROM
    (SELECT free_score, row_number() OVER (ORDER BY free_score, item_id) AS rn, count(*) OVER () AS n FROM items) t
    CROSS JOIN (SELECT 30 AS p UNION ALL SELECT 55 UNION ALL SELECT 85) q GROUP BY p""")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at place min(n - 1, floor(p n / 100)) of the sorted scores, from 0."""
    r = ranked(_view(spark, sf_dir, "items").select("free_score", "item_id"), "free_score", "item_id")
    total = r.agg(F.count("*").alias("n"))
    place = F.least(F.col("n") - 1, F.floor(F.col("p") * F.col("n") / 100)) + 1
    wanted = spark.createDataFrame([(30,), (55,), (85,)], "p int").crossJoin(F.broadcast(total)).select("p", place.alias("rn"))
    return r.join(F.broadcast(wanted), "rn").select("p", F.col("free_score").alias("value"))


@query("q12_deep_false_negatives", """
    SELECT count(*) AS n, max(CASE WHEN rn = (n - n % 2) / 2 + 1 THEN audit_score END) AS median, CAST(sum(CASE WHEN would_have_published THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM
    (SELECT audit_score, would_have_published, row_number() OVER (ORDER BY audit_score, item_id) AS rn, count(*) OVER () AS n FROM audits WHERE boundary = 'triage_to_deep' AND would_have_published IS NOT NULL) t""")
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved audits of the deep boundary: how many, their upper median score, and what would have been published."""
    a = _view(spark, sf_dir, "audits").where("boundary = 'triage_to_deep' AND would_have_published IS NOT NULL").select("audit_score", "would_have_published", "item_id")
    r = ranked(a, "audit_score", "item_id")
    totals = r.agg(F.count("*").alias("n"), F.coalesce(F.count_if("would_have_published"), F.lit(0)).alias("misses"))
    middle = totals.join(r.select("rn", F.col("audit_score").alias("median")), F.floor(F.col("n") / 2) + 1 == F.col("rn"), "left")
    return middle.select("n", "median", F.when(F.col("n") > 0, F.col("misses")).alias("misses"))


@query("d8_ordered_concat", """
    SELECT CAST(row_number() OVER (ORDER BY part, item_id) AS BIGINT) AS ord, item_id FROM (SELECT 0 AS part, item_id FROM deep WHERE item_id % 10 = 6 UNION ALL SELECT 1, item_id FROM items WHERE status = 'triaged') t""")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists one after the other, numbered through."""
    stale = _view(spark, sf_dir, "deep").where("item_id % 10 = 6").select(F.lit(0).alias("part"), "item_id")
    waiting = _view(spark, sf_dir, "items").where("status = 'triaged'").select(F.lit(1).alias("part"), "item_id")
    return ranked(stale.unionByName(waiting), "part", "item_id").select(F.col("rn").alias("ord"), "item_id")


_BAND = "CASE WHEN free_score >= 0.396e0 THEN 'A' WHEN free_score >= 0.299e0 THEN 'B' WHEN free_score >= 0.242e0 THEN 'C' ELSE 'D' END"


@query("w3_running_budget", f"""
    SELECT item_id, band, slots <= 140 AND band IN ('A', 'B') AS sent FROM (SELECT item_id, band, sum(CASE WHEN band IN ('A', 'B') THEN 1 ELSE 0 END)
    OVER (ORDER BY free_score DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS slots FROM (SELECT item_id, free_score, {_BAND} AS band FROM items) b) t""")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands A and B share 140 slots in score order: the best 140 of them, found as a top-k."""
    banded = _view(spark, sf_dir, "items").select("item_id", "free_score", scoring.band(F.col("free_score")).alias("band"))
    return scoring.slots_and_audits(banded, 140, 1).select("item_id", "band", F.col("selected").alias("sent"))


@query("j15_article_episode_window", f"""
    SELECT e.item_id AS episode, count(*) AS articles FROM (SELECT item_id, language, first_seen_at FROM items WHERE status = 'new') e
    JOIN (SELECT item_id, language, first_seen_at FROM items WHERE status = 'published') a ON a.language = e.language AND e.first_seen_at >= a.first_seen_at - 96 * {N.HOUR} GROUP BY e.item_id""")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each episode the articles of its language up to 96 hours after it, counted without pairing.

    Articles are counted by language and hour; hours are summed up (a row an hour), and only the episode's own hour is counted row by row.
    """
    items = _view(spark, sf_dir, "items").where("language IS NOT NULL").select("item_id", "language", "first_seen_at", "status")
    at = F.when(F.col("status") == "published", F.col("first_seen_at") - 96 * N.HOUR).otherwise(F.col("first_seen_at"))
    moments = (items.where("status IN ('new', 'published')").withColumns({"at": at, "episode": (F.col("status") == "new").cast("int")})
               .withColumn("hour", F.floor(F.col("at") / N.HOUR)))
    hours = moments.groupBy("language", "hour").agg(F.sum(1 - F.col("episode")).alias("n"))
    before = hours.select("language", "hour", F.coalesce(F.sum("n").over(Window.partitionBy("language").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum(1 - F.col("episode")).over(Window.partitionBy("language", "hour").orderBy("at", "episode").rowsBetween(Window.unboundedPreceding, 0))
    counted = moments.withColumn("inside", inside).where("episode = 1").join(before, ["language", "hour"])
    return counted.select(F.col("item_id").alias("episode"), (F.col("before") + F.col("inside")).alias("articles")).where("articles > 0")


@query("a12_bucket_counts", """
        SELECT dimension, bucket, count(*) AS n, CAST(sum(CASE WHEN audit_result = 'KEEP' THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM (
          SELECT 'band' AS dimension, band AS bucket, audit_result FROM audits UNION ALL
          SELECT 'length', CASE WHEN word_count < 300 THEN 'short' WHEN word_count < 1500 THEN 'medium' ELSE 'long' END, audit_result FROM audits UNION ALL
          SELECT 'prior', CASE WHEN source_prior < 0.4e0 THEN 'low' WHEN source_prior < 0.7e0 THEN 'mid' ELSE 'high' END, audit_result FROM audits UNION ALL
          SELECT 'interest', CASE WHEN semantic_interest < 0.3e0 THEN 'far' WHEN semantic_interest < 0.6e0 THEN 'near' ELSE 'close' END, audit_result FROM audits UNION ALL
          SELECT 'serendipity', CASE WHEN is_serendipity THEN 'yes' ELSE 'no' END, audit_result FROM audits UNION ALL
          SELECT 'content_type', content_type, audit_result FROM audits UNION ALL
          SELECT 'source', source_id, audit_result FROM audits UNION ALL SELECT 'boundary', boundary, audit_result FROM audits) t
        WHERE audit_result IS NOT NULL GROUP BY dimension, bucket""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits by eight groupings in one pass."""
    c = F.col
    buckets = {
        "band": c("band"), "length": F.when(c("word_count") < 300, "short").when(c("word_count") < 1500, "medium").otherwise("long"), "prior": F.when(c("source_prior") < .4, "low").when(c("source_prior") < .7, "mid").otherwise("high"),
        "interest": F.when(c("semantic_interest") < .3, "far").when(c("semantic_interest") < .6, "near").otherwise("close"), "serendipity": F.when(c("is_serendipity"), "yes").otherwise("no"), "content_type": c("content_type"),
        "source": c("source_id"), "boundary": c("boundary")}
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("bucket")) for k, v in buckets.items()]))
    known = _view(spark, sf_dir, "audits").where("audit_result IS NOT NULL").select(one.alias("d"), "audit_result")
    return known.groupBy("d.dimension", "d.bucket").agg(F.count("*").alias("n"), F.count_if(c("audit_result") == "KEEP").alias("misses"))


@query("a13_upper_median", """
        SELECT boundary, max(CASE WHEN rn = (n - n % 2) / 2 + 1 THEN audit_score END) AS median FROM
        (SELECT boundary, audit_score, row_number() OVER (PARTITION BY boundary ORDER BY audit_score, item_id) AS rn, count(*) OVER (PARTITION BY boundary) AS n FROM audits) t GROUP BY boundary""")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median score of each boundary, the upper of two, without sorting a boundary in one task."""
    r = ranked_within(_view(spark, sf_dir, "audits").select("boundary", "audit_score", "item_id"), "boundary", "audit_score", "item_id")
    return r.where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select("boundary", F.col("audit_score").alias("median"))


@query("w1_rank_in_source", """SELECT item_id, source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY free_score DESC, first_seen_at DESC, item_id) AS BIGINT) AS rank_in_run FROM items""")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each item among its source's, best first; a source that holds a third of all items is spread over tasks."""
    items = _view(spark, sf_dir, "items").select("item_id", "source_id", "free_score", "first_seen_at")
    return ranked_within(items, "source_id", F.desc("free_score"), F.desc("first_seen_at"), "item_id").select("item_id", "source_id", F.col("rn").alias("rank_in_run"))


@query("w13_stratified_sample", """
        SELECT band, item_id FROM (SELECT band, item_id, rn, greatest(1, floor(n / 10e0)) AS step FROM (SELECT band, item_id, row_number() OVER (PARTITION BY band ORDER BY audit_score, item_id) AS rn,
        count(*) OVER (PARTITION BY band) AS n FROM audits) a) t WHERE (rn - 1) % step = 0 AND (rn - 1) / step < 10""")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten evenly spaced audits of each band, in score order."""
    r = ranked_within(_view(spark, sf_dir, "audits").select("band", "audit_score", "item_id"), "band", "audit_score", "item_id")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    return r.where(((F.col("rn") - 1) % step == 0) & (F.floor((F.col("rn") - 1) / step) < 10)).select("band", "item_id")
