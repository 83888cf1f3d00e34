"""Operator 4: exact dedup by skew-safe combining.

Copies are merged in three steps, each comparing whole contents and never digests alone:
inside an Arrow batch (local), between the batches that share a digest and a salt, and between the
winners of a digest's salts. A group that holds a third of all rows is first cut down to one winner
per batch, and no later task sees more than a salt's share of those winners. Only winners whose
digest has been met in more than one batch carry their text on: the others have nothing to be
compared with. Every step writes down "loser -> winner" pairs of ids only; two different texts with
one digest would stay apart.

Defined results: null text counts as empty; empty texts are equal to each other; repeated rows (same
id, same text) are counted each and get the same answer; a null id is smaller than every other, so a group's
keep_id is null only if all its ids are, and kept is null for a row without an id, as in the SQL; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.llm.common import park, small_batches, table, whole_ids

#: Winners' ids are broadcast up to this many rows (56 bytes each); beyond it their texts are shuffled by id.
BROADCAST_ROWS = 200_000


def _local(batches):
    """Within a batch: the largest id of each content wins. A dictionary compares contents whole; pandas' own grouping stops at NUL characters.

    A content without any id in the batch can't be found again by id: its first row carries the text along.
    """
    lot = TaskContext.get().partitionId()
    for pdf in batches:
        text, none = pdf["text"].fillna("").tolist(), pdf["no_id"].tolist()
        ids = [None if z else i for i, z in zip(pdf["doc_id"].tolist(), none, strict=True)]
        win: dict[str, int | None] = {}
        for t, i in zip(text, ids, strict=True):
            had = win.setdefault(t, i)
            if had is None or i is not None and i > had:
                win[t] = i
        bare = {t for t, i in win.items() if i is None}
        carried = []
        for t in text:
            carried.append(t if t in bare else None)
            bare.discard(t)
        yield pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "digest": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in text],
            "local_id": pd.array([win[t] for t in text], "Int64"), "carried": carried, "lot": lot})


def _meets(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left joined with right on digest and an id that may be null on both sides."""
    right = right.withColumnRenamed(on, "_on").withColumnRenamed("digest", "_digest")
    return left.join(right, F.col(on).eqNullSafe(F.col("_on")) & (F.col("digest") == F.col("_digest")), how).drop("_on", "_digest")


#: Winners of one digest that a salt takes, on average, before more salts are used.
WINNERS_PER_SALT = 1024


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text); salts is the least number of salts."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    ids = park(whole_ids(docs).mapInPandas(_local, "doc_id long, digest binary, local_id long, carried string, lot int"))
    local = ids.groupBy("local_id", "digest").agg(F.count("*").alias("n"))
    repeated = local.groupBy("digest").agg(F.count("*").alias("met")).where("met > 1").select("digest")
    winners = park(local.join(repeated, "digest", "left_semi"))
    most = winners.groupBy("digest").count().agg(F.max("count")).first()[0] or 0
    salts = max(salts, -(-most // WINNERS_PER_SALT))

    picked = winners.where("local_id is not null").select("local_id", "digest")
    if winners.count() <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    text = F.coalesce("text", F.lit(""))
    met = (docs.join(picked, docs["doc_id"] == picked["local_id"])
           .select("local_id", "digest", text.alias("text"))
           .where(F.unhex(F.sha2("text", 256)) == F.col("digest"))
           # a row that stands many times comes back as many times: once is enough
           .distinct()
           .withColumn("salt", F.pmod(F.xxhash64("local_id"), F.lit(salts))))
    bare = (ids.where("carried is not null").join(winners.where("local_id is null").select("digest"), "digest", "left_semi")
            .select("local_id", "digest", F.col("carried").alias("text"), F.pmod(F.xxhash64("lot"), F.lit(salts)).alias("salt")))
    salted = park(met.union(bare).withColumn("salt_id", F.max("local_id").over(Window.partitionBy("digest", "salt", "text")))
                  .select("local_id", "digest", "salt_id", F.when(F.col("local_id").eqNullSafe(F.col("salt_id")), F.col("text")).alias("text")))
    tops = (salted.where("text is not null")
            .select("digest", "salt_id", F.max("salt_id").over(Window.partitionBy("digest", "text")).alias("keep_id")))
    pairs = (_meets(salted.select("local_id", "digest", "salt_id").distinct(), tops.distinct(), "salt_id")
             .select("local_id", "digest", "keep_id").distinct())
    pairs = park(_meets(pairs, winners, "local_id"))
    sizes = pairs.groupBy("keep_id", "digest").agg(F.sum("n").alias("size"))
    merged = _meets(pairs, sizes, "keep_id").select("local_id", "digest", "keep_id", "size")
    # a null keep_id of merged rows stands for itself: then all ids of the group are null, local_id too
    answer = (_meets(local, merged, "local_id", "left")
              .select("local_id", "digest", F.coalesce("keep_id", "local_id").alias("keep_id"), F.coalesce("size", "n").alias("group_size")))
    return (_meets(ids.select("doc_id", "digest", "local_id"), answer, "local_id")
            .select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
