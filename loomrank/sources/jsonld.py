"""JSON-LD of pages: scripts found in the html, parsed to variants and flattened, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys under which JSON-LD nests further objects, and how deep it is followed.
NESTING = ("@graph", "itemListElement", "associatedMedia", "hasPart", "mainEntity")
DEPTH = 6


def scripts(html: Column) -> Column:
    """Bodies of the page's JSON-LD scripts."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


def flatten(values: DataFrame, key: str, value: str, depth: int = DEPTH, nesting: tuple[str, ...] | None = NESTING) -> DataFrame:
    """key, place, depth, node: every object of values(key, value variant) that nesting keys (all keys if None) and arrays lead to, at most `depth` steps down.

    place sorts a row's objects in the order of a walk: an object before what it holds, keys as listed, elements in order. Each step is one lateral
    explode, without a shuffle; what isn't an object or an array ends there.
    """
    spark = values.sparkSession
    level = values.select(key, F.lit("").alias("place"), F.col(value).alias("node")).where("node IS NOT NULL")
    out = None
    for k in range(depth + 1):
        found = level.where(F.schema_of_variant("node").startswith("OBJECT")).withColumn("depth", F.lit(k))
        out = found if out is None else out.unionByName(found)
        if k < depth:
            inner = level.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()).toDF("_pos", "_key", "_value"))
            # elements of an array have no key
            order = F.col("_pos") if nesting is None else F.coalesce(F.array_position(F.array(*map(F.lit, nesting)), F.col("_key")), F.col("_pos"))
            if nesting is not None:
                inner = inner.where(F.col("_key").isNull() | F.col("_key").isin(*nesting))
            level = inner.where(~F.is_variant_null("_value")).select(F.col(key), F.concat("place", F.lpad(order.cast("string"), 6, "0"), F.lit(".")).alias("place"), F.col("_value").alias("node"))
    return out.select(key, "place", "depth", "node")


def text_of(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def publisher(node: Column) -> Column:
    """Name of publisher, series or author: a string itself, or its `name`."""
    first = F.coalesce(*[F.try_variant_get(node, f"$.{k}", "variant") for k in ("publisher", "partOfSeries", "author")])
    kind = F.schema_of_variant(first)
    return F.when(kind == "STRING", F.try_variant_get(first, "$", "string")).when(kind.startswith("OBJECT"), F.try_variant_get(first, "$.name", "string"))
