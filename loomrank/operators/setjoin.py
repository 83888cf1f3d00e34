"""Exact set-similarity join with prefix, length and position filters, and as-of joins without sliding frames; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.functions.numbers import HOUR

#: So many of the most frequent tokens are put last in a set's order; they are broadcast (about 40 bytes each). The order changes the work, never a result.
FREQUENT = 10_000
#: Bits that stand for a set while it is compared; more of them let fewer pairs through that aren't similar.
BITS = 256
_SEPARATOR = "\x1f"


def set_key(tokens: Column) -> Column:
    """One string for a set of tokens, the same whatever their order; null for the empty set, which is similar to nothing."""
    return F.when(F.size(tokens) > 0, F.array_join(F.array_sort(F.array_distinct(tokens)), _SEPARATOR))


def different_sets(keys: DataFrame, column: str) -> DataFrame:
    """key, tokens: each different set that stands in the column, once. Copies meet in partial aggregation, so a group of any size is one row."""
    return keys.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.lit(1).alias("_")).select("key", F.split("key", _SEPARATOR).alias("tokens"))


def _least(x: Column) -> Column:
    """The smallest whole number not under x, forgiving for rounding."""
    return F.ceil(x - 1e-9).cast("int")


def set_id(key: Column) -> Column:
    """16 bytes that stand for a long key in shuffles and joins; null for null."""
    return F.unhex(F.md5(key))


def bit_words(tokens: Column, words: int) -> list[Column]:
    """So many longs that stand for a set: each token sets one bit."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def word(w: int) -> Column:
        bit = lambda t: F.when(F.pmod(F.shiftright(F.xxhash64(t), 6), F.lit(words)) == w, F.call_function("shiftleft", one, F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))).otherwise(none)
        return F.aggregate(tokens, none, lambda x, t: x.bitwiseOR(bit(t)))

    return [word(w) for w in range(words)]


def most_alike(n: Column, m: Column, left: list[Column], right: list[Column]) -> Column:
    """No smaller than the Jaccard of two sets of n and m tokens with these bits: each bit that differs is a token of one set alone."""
    apart = F.greatest(F.abs(n - m), reduce(Column.__add__, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(left, right, strict=True)]))
    return (n + m - apart) / F.greatest(F.lit(1), n + m + apart)


def met_sets(left: DataFrame, right: DataFrame, cut: float, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """left_id, right_id: hashes of the ids of all pairs of left(id, tokens, ...) and right(id, tokens, ...) with Jaccard >= cut, and others; ids must be unique on each side.

    Tokens are put in one order, frequent ones last. Two sets that are similar enough share a token among their first n - ceil(cut n) + 1, so
    only those meet. What meets is narrow: hash of the id, hash of the token, lengths, the token's place and 256 bits of the set. Lengths, places and bits bound the
    overlap. Further columns travel with the sets; where(most) may ask about them as left_ and right_ columns, where `most` is
    no smaller than the Jaccard. A frequent token leads only sets that hold nothing rarer; what is left of skew is split by the adaptive join.
    """
    further = [c for c in left.columns if c in right.columns and c not in ("id", "tokens")]
    frequent = (left.select("tokens").union(right.select("tokens")).select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
                .where("n > 1").orderBy(F.desc("n"), "t").limit(FREQUENT))
    words = range(BITS // 64)

    def ready(d: DataFrame, p: str) -> DataFrame:
        held = F.struct("id", *further)
        placed = (d.select(held.alias("held"), F.explode("tokens").alias("t")).join(F.broadcast(frequent), "t", "left")
                  .groupBy("held").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("t")))).alias("s")))
        size = F.size("s")
        first = F.slice("s", 1, F.greatest(F.lit(0), size - _least(cut * size) + 1))
        bits = bit_words(F.transform("s", lambda x: x["t"]), len(words))
        return (placed.select(F.xxhash64("held.id").alias(f"{p}_id"), *[F.col(f"held.{c}").alias(f"{p}_{c}") for c in further], size.alias(f"{p}_n"), *[x.alias(f"{p}_bits{w}") for w, x in enumerate(bits)], first.alias("first"))
                .select("*", F.posexplode("first").alias(f"{p}_at", "x")).withColumn("t", F.xxhash64("x.t")).drop("x", "first"))

    n, m = F.col("left_n"), F.col("right_n")
    rest = F.least(n - F.col("left_at"), m - F.col("right_at"))
    most = most_alike(n, m, *[[F.col(f"{p}_bits{w}") for w in words] for p in ("left", "right")])
    met = ready(left, "left").join(ready(right, "right"), "t").where((rest >= cut / (1 + cut) * (n + m) - 1e-9) & (most >= cut - 1e-9))
    return (met if where is None else met.where(where(most))).select("left_id", "right_id").distinct()


def similar_sets(left: DataFrame, right: DataFrame, cut: float) -> DataFrame:
    """left_key, right_key, jaccard of all pairs of left(key, tokens) and right(key, tokens) with Jaccard >= cut; keys must be unique on each side.

    Pairs that may be similar enough are met by hashes of the keys; their tokens decide. So equal hashes add work, never a row.
    """
    sides = [d.select(set_id("key").alias("id"), "key", "tokens") for d in (left, right)]
    told = lambda d, p: d.select(F.xxhash64("id").alias(f"{p}_id"), F.col("key").alias(f"{p}_key"), F.col("tokens").alias(f"{p}_tokens"))
    both = (met_sets(*[d.select("id", "tokens") for d in sides], cut).join(told(sides[0], "left"), "left_id").join(told(sides[1], "right"), "right_id")
            .withColumn("o", F.size(F.array_intersect("left_tokens", "right_tokens"))))
    return (both.select("left_key", "right_key", F.when(F.col("o") > 0, F.col("o") / (F.size("left_tokens") + F.size("right_tokens") - F.col("o"))).otherwise(0.0).alias("jaccard"))
            .where(F.col("jaccard") >= cut))


def first_from(asks: DataFrame, events: DataFrame, hours: int = 6) -> DataFrame:
    """asks(ask, key, at) with found_at and found: the earliest event(key, at, id) of the same key at or after `at`, the smallest id among equals; null if none.

    Events and asks of one key and some hours are sorted together and the next event is carried back, so the work is linear; what lies in
    later hours is one row per key and hours. So a key that holds most rows is spread over its hours. at is in milliseconds.
    """
    width = hours * HOUR
    bucket = F.floor(F.col("at") / width).alias("bucket")
    one = events.groupBy("key", "at").agg(F.min("id").alias("id")).select("key", "at", "id", bucket)
    whole = one.groupBy("key", "bucket").agg(F.min(F.struct("at", "id")).alias("head"))
    asked = asks.select("ask", "key", "at", bucket)
    # the next bucket with an event, from each bucket with an event or a question: one row each
    steps = whole.unionByName(asked.select("key", "bucket").distinct(), allowMissingColumns=True).groupBy("key", "bucket").agg(F.first("head", ignorenulls=True).alias("head"))
    later = Window.partitionBy("key").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = steps.select("key", "bucket", F.last("head", ignorenulls=True).over(later).alias("next"))
    mixed = (one.select("key", "bucket", "at", F.struct("at", "id").alias("here"))
             .unionByName(asked, allowMissingColumns=True))
    # at one time events come before questions in the order that runs backwards
    back = Window.partitionBy("key", "bucket").orderBy(F.desc("at"), F.col("here").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = mixed.withColumn("found", F.last("here", ignorenulls=True).over(back)).where("here IS NULL")
    return (inside.join(nexts, ["key", "bucket"], "left").withColumn("found", F.coalesce("found", "next"))
            .select("ask", "key", "at", F.col("found.at").alias("found_at"), F.col("found.id").alias("found")))


def last_until(asks: DataFrame, events: DataFrame, hours: int = 6) -> DataFrame:
    """As first_from(), backwards: the latest event at or before `at`, the smallest id among equals."""
    turned = first_from(asks.withColumn("at", -F.col("at")), events.withColumn("at", -F.col("at")), hours)
    return turned.withColumns({"at": -F.col("at"), "found_at": -F.col("found_at")})
