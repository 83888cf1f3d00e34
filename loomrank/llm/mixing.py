"""Operator 8: mixing sources to target weights with Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / quality (u from a hash of its id, so reruns agree);
ascending keys are a weighted sample without replacement of any size. Within each source the keys are
sorted and the sizes prefix-summed up to the source's budget; whole epochs come first, and only the
rest of the budget is taken from the sorted order.

Sorting is one range partitioning by (source, key): partition sums per source give each partition its
offset, and the running sum is then local to a partition, so a source that holds a third of all rows
is spread like any other. Targets are computed on one row per source.

Defined results: sources go by code point, null last; null or empty text has size 0 and is taken 0 times;
the document on which the budget ends is taken if that brings the total nearer; equal keys go by id, then
size, then a hash of the row; rows equal in all of these are counted as one before sorting, and as many of them
are taken as the budget holds; a null id draws one fixed key; an empty table gives no rows; other columns are carried,
those named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.llm.common import SPACES, masked, park, table, without, words_of

MAX_EPOCHS = 3

#: The per-source plan is broadcast up to this many sources (about 80 bytes each); beyond it Spark joins by source.
BROADCAST_ROWS = 100_000


def quality(text: Column) -> Column:
    """Weight in [0.05, 1]: what five times the share of symbols among the text's word characters leaves."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(without(text, SPACES))
    symbols = F.length(text) - F.length(without(text, "#*$%&|<>"))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * symbols / F.greatest(chars, F.lit(1)))


def unit(doc_id: Column) -> Column:
    """In (0, 1), from the first 52 bits of the id's md5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target from sizes(source, source_size): weights repeat in code-point order, null last.

    A source's target is least(3 x size, level x weight), with the level at which targets add up to all
    sizes. Sources reach their cap in order of size per weight, so the level is found by prefix sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    filled = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before, every = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    size = F.col("source_size")
    left = F.sum(size).over(every) - MAX_EPOCHS * F.coalesce(F.sum(size).over(before), F.lit(0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = w.withColumns({"level": left / open_w, "cap": MAX_EPOCHS * size})
    level = level.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    final = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"]
    return level.select("source", "source_size", F.round(F.least(
        F.col("cap").cast("double"), F.coalesce(final * F.col("w"), F.lit(0.0))), 6).alias("target"))


ORDER = ["_key", "doc_id", "size", "_row"]


def _draw(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_row": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]),
                             "size": F.size(words_of(F.col("text"))).cast("long"), "_key": -F.log(unit(F.col("doc_id"))) / quality(F.col("text"))})


def _plan(drawn: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source with its target, whole epochs, edge (the last rows taken once more), how many rows the edge has and how many of them are taken."""
    n = max(2, int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = drawn.groupBy("source", *ORDER).agg(F.count("*").alias("_n"))
    ranged = park(counted.repartitionByRange(n, "source", *ORDER).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("source", "_part").agg(F.sum(F.col("size") * F.col("_n")).alias("part_size"))
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights)
    goal = park(goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.withColumn("before_part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
               .join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
               .select("_s", F.col("_part").alias("_p"), "before_part", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
               .where(F.col("before_part") <= F.col("rest")))
    inside = Window.partitionBy("source", "_part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before_part") - F.col("before") - F.col("size") / 2
    most = F.when(F.col("size") > 0, F.least(F.col("_n"), F.floor(left / F.col("size")) + 1)).otherwise(F.col("_n"))
    edge = (ranged.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("_n")).over(inside), F.lit(0)))
            .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
            .where((F.col("rest") > 0) & (left >= 0)).withColumn("_most", most)
            .groupBy(F.col("source").alias("_e")).agg(F.max(F.struct(*ORDER, "_n", "_most")).alias("_last")))
    return park(goal.join(edge, F.col("source").eqNullSafe(F.col("_e")), "left")
                .select(F.col("source").alias("_s"), "source_size", "target", "whole",
                        F.when(F.col("_last").isNotNull(), F.struct(*[F.col(f"_last.{c}") for c in ORDER])).alias("_edge"), "_last._n", "_last._most"))


def _apply(drawn: DataFrame, plan: DataFrame, broadcast_rows: int, lot: int = 4096) -> DataFrame:
    split = not plan.where("_most < _n").isEmpty()
    if plan.count() <= broadcast_rows:
        plan = F.broadcast(plan)
    met = drawn.drop("source_size", "target", "epochs", "taken", "whole").join(plan, F.col("source").eqNullSafe(F.col("_s")))
    place = F.struct(*ORDER)
    met = met.withColumn("_more", F.when(place <= F.col("_edge"), 1).otherwise(0))
    if split:
        # equal rows, of which some are taken once more: counted, then dealt out in lots, so that none meets all of them
        shared = F.coalesce((place == F.col("_edge")) & (F.col("_most") < F.col("_n")), F.lit(False))
        names = met.columns
        equal = met.where(shared).groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count("*").alias("_copies"))
        equal = equal.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / lot)))).repartition("_row", "_lot")
        equal = equal.withColumn("_i", F.explode(F.sequence(F.col("_lot") * lot, F.least(F.col("_copies"), (F.col("_lot") + 1) * lot) - 1)))
        met = met.where(~shared).unionByName(equal.withColumn("_more", F.when(F.col("_i") < F.col("_most"), 1).otherwise(0)).select(*[F.col(f"`{c}`") for c in names]))
    return (met.withColumn("epochs", F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.col("_more")).cast("long"))
            .withColumn("taken", F.col("size") * F.col("epochs"))
            .drop("_s", "_edge", "_n", "_most", "_more", "_key", "_row", "whole"))


def shares(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole ones), taken (words, repeats counted); texts are read once."""
    drawn = park(_draw(docs.select("doc_id", "source", "text")).select("source", *ORDER))
    return _apply(drawn, _plan(drawn, weights), broadcast_rows)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with the columns of shares(). Only ids, keys and sizes are sorted; a source's edge, the last (key, id, size, row hash)
    that is taken once more, is laid against the documents where they lie, so texts are never shuffled (but for equal rows on an edge)."""
    made = ("size", "source_size", "target", "epochs", "taken")
    plain, names = masked(docs.drop(*made), "doc_id", "source", "text")
    drawn = _draw(plain)
    mixed = _apply(drawn, _plan(drawn, weights), broadcast_rows)
    return mixed.select(*[F.col(c).alias(outer) for c, outer in names.items()], *made)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_SQL = r"""
WITH RECURSIVE base AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || left(md5(coalesce(doc_id::VARCHAR, 'null')), 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / greatest(0.05, 1.0 - 5.0 * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))
                              / greatest(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')), 1)) AS key
  FROM {docs}),
srcs AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT AS w
  FROM base GROUP BY source),
fill AS (
  SELECT 0 AS it, source, source_size, w, false AS capped FROM srcs
  UNION ALL
  SELECT it + 1, source, source_size, w, capped OR lvl * w > 3 * source_size
  FROM (SELECT *, (sum(source_size) OVER () - 3 * sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ())
                  / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) AS lvl FROM fill) WHERE it < 30),
goal AS (
  SELECT source, source_size, CASE WHEN capped THEN 3.0 * source_size
    ELSE w * (sum(source_size) OVER () - 3 * sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ())
           / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS exact
  FROM fill WHERE it = 30),
run AS (
  SELECT base.*, source_size, round(exact::DOUBLE, 6) AS target, CASE WHEN source_size > 0 THEN floor(round(exact::DOUBLE, 6) / source_size) ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base JOIN goal ON base.source IS NOT DISTINCT FROM goal.source)
SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN target - whole * source_size > 0 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END END::BIGINT AS epochs
FROM run
"""


def mix_sql(docs: str) -> str:
    return _SQL.replace("{docs}", docs)


ORACLE = f"SELECT doc_id, size, source_size, target, (size * epochs)::BIGINT AS taken FROM ({mix_sql('documents')})"
