"""Operator 10: URL filters: longest-match host and path rules, and boosted trees on lexical features for the rest.

The trees are trained on labelled URLs (here: those that a rule decides) by Spark ML's distributed
gradient-boosted trees, so training rows stay in Spark. Features are length, depth, digit ratio,
character entropy, parameter count, host labels, hyphens, and two statistics of the host's suffix among all
URLs (the last two labels: its count, and its labelled block rate smoothed towards the whole rate). A training row's block rate is that of
the other folds' rows, so no row is taught by its own label.

Defined results: null urls and urls without "://" have an empty host and path, match no rule and are
judged by the trees from zero features; repeated rows get equal verdicts; without labelled URLs of both
kinds the verdict is the only label known, or allow; equal labelled rows are one training row with their number as weight; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm.common import bind, park, table

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffix statistics are broadcast up to this many suffixes.
BROADCAST_ROWS = 100_000
SMOOTHING = 50.0
FOLDS = 5
FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_suffix_count", "f_suffix_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character of the whole text: its characters are sorted and the lengths of equal runs added up."""
    def of(chars):
        start = F.struct(F.lit("").alias("c"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
        closed = lambda a: a["sum"] + F.when(a["run"] > 1, a["run"] * F.log2(a["run"].cast("double"))).otherwise(0.0)
        runs = F.aggregate(F.array_sort(chars), start, lambda a, x: F.when(a["c"] == x, F.struct(
            a["c"].alias("c"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(x.alias("c"), F.lit(1).alias("run"), closed(a).alias("sum"))), closed)
        return F.when(F.size(chars) > 0, F.log2(F.size(chars).cast("double")) - runs / F.size(chars)).otherwise(0.0)
    return bind(F.filter(F.split(text, ""), lambda c: c != ""), of)


def lexical(urls: DataFrame) -> DataFrame:
    """urls(url, host, path) with the features that need no other row."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    return urls.withColumns({
        "f_length": n.cast("double"),
        "f_depth": F.size(F.array_remove(F.split("path", "/"), "")).cast("double"),
        "f_digits": (n - F.length(F.translate(url, "0123456789", ""))) / F.greatest(n, F.lit(1)),
        "f_entropy": _entropy(F.concat("host", "path")),
        "f_params": F.when(F.instr(url, "?") > 0, 1 + n - F.length(F.translate(url, "&", ""))).otherwise(0).cast("double"),
        "f_labels": F.size(F.split("host", r"\.")).cast("double"),
        "f_hyphens": (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double"),
        "suffix": F.substring_index("host", ".", -2),
    })


def url_filter(urls: DataFrame, labelled: DataFrame, trees: int = 10, depth: int = 4, max_train_rows: int = 50_000) -> DataFrame:
    """urls(url, host, path, ...) with p_block and the trees' verdict; labelled(url, host, path, blocked double).

    max_train_rows bounds the different labelled rows that fit the trees (those of the smallest hashes); suffix statistics use all rows.
    """
    ready = lexical(urls)
    counts = ready.groupBy("suffix").agg(F.count("*").alias("n"))
    different = park(labelled.groupBy("url", "host", "path", "blocked").agg(F.count("*").cast("double").alias("weight"))
                     .withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")))
    folds = lexical(different).groupBy("suffix", "fold").agg(F.sum(F.col("blocked") * F.col("weight")).alias("hits"), F.sum("weight").alias("known"))
    known = folds.groupBy("suffix").agg(F.sum("hits").alias("hits"), F.sum("known").alias("known"))
    totals = labelled.agg(F.avg("blocked").alias("rate"), F.count("*").alias("rows")).first()
    if totals["rows"] == 0 or totals["rate"] in (0.0, 1.0):
        verdict = "block" if totals["rate"] == 1.0 else "allow"
        return ready.withColumns({"p_block": F.lit(1.0 if verdict == "block" else 0.0), "verdict": F.lit(verdict)})
    rate = lambda hits, rows: ((F.coalesce(hits, F.lit(0.0)) + SMOOTHING * totals["rate"]) / (F.coalesce(rows, F.lit(0.0)) + SMOOTHING)).alias("f_suffix_rate")
    stats = park(counts.join(known, "suffix", "left").select("suffix", F.log1p("n").alias("f_suffix_count"), rate(F.col("hits"), F.col("known"))))
    # what the other folds say of a suffix: a row per suffix and fold
    others = park(counts.join(folds, "suffix").join(known.select("suffix", F.col("hits").alias("all_hits"), F.col("known").alias("all_known")), "suffix").select(
        "suffix", "fold", F.log1p("n").alias("f_suffix_count"), rate(F.col("all_hits") - F.col("hits"), F.col("all_known") - F.col("known"))))
    if stats.count() <= BROADCAST_ROWS:
        stats, others = F.broadcast(stats), F.broadcast(others)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    train = different.withColumn("_h", F.xxhash64("url", "blocked")).orderBy("_h", "url", "blocked").limit(max_train_rows)
    train = park(lexical(train).join(others, ["suffix", "fold"], "left").fillna(0.0, list(FEATURES)).select(*FEATURES, "blocked", "weight"))
    model = GBTClassifier(featuresCol="_features", labelCol="blocked", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11).fit(assemble.transform(train))
    scored = model.transform(assemble.transform(ready.join(stats, "suffix", "left").fillna(0.0, list(FEATURES))))
    p = vector_to_array("probability")[1]
    return scored.withColumn("p_block", p).withColumn("verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for pages(page_id, url): the rule's verdict, else the trees'."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": name, "said": said})
    labelled = ruled.where("said is not null").select("url", "host", "path", (F.col("said") == "block").cast("double").alias("blocked"))
    return (url_filter(ruled, labelled)
            .select("page_id", "host", "path", "rule", F.coalesce("said", "verdict").alias("verdict"), F.round("p_block", 6).alias("p_block")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pages table."""
    return judge(table(spark, sf_dir, "pages"))
