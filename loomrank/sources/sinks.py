"""Rendered feeds and key-value documents as string expressions; writing is Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions.text import escape_xml


def _stamp(ms: Column, form: str) -> Column:
    return F.date_format(F.timestamp_millis(ms), form)


def rss_item() -> Column:
    return F.concat(F.lit("<item><title>"), escape_xml(F.col("title")), F.lit("</title><link>"), escape_xml(F.col("url")), F.lit("</link><guid>"), F.col("item_id").cast("string"),
                    F.lit("</guid><pubDate>"), _stamp(F.col("published_at"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate></item>"))


def atom_entry() -> Column:
    return F.concat(F.lit("<entry><title>"), escape_xml(F.col("title")), F.lit('</title><link href="'), escape_xml(F.col("url")), F.lit('"/><id>'), F.col("item_id").cast("string"),
                    F.lit("</id><updated>"), _stamp(F.col("published_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>"))


def latest(items: DataFrame, most: int = 60) -> DataFrame:
    """The newest `most` items of each feed, which is what a feed document holds."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("feed").orderBy(F.desc("published_at"), "item_id")
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def documents(items: DataFrame, kind: str, most: int = 60) -> DataFrame:
    """feed, body: one RSS, Atom or JSON Feed document per feed. items: feed, item_id, title, url, published_at."""
    top = latest(items, most)
    if kind == "json":
        entry = F.struct("place", F.struct(F.col("item_id").cast("string").alias("id"), "title", "url", _stamp(F.col("published_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published")).alias("e"))
        body = F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.first("feed").alias("title"),
                                  F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("items")))
        return top.groupBy("feed").agg(body.alias("body"))
    text = rss_item() if kind == "rss" else atom_entry()
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("e")))), lambda x: x["e"]), "")
    head, tail = ("<rss version=\"2.0\"><channel><title>", "</channel></rss>") if kind == "rss" else ("<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>", "</feed>")
    return top.groupBy("feed").agg(F.concat(F.lit(head), F.first("feed"), F.lit("</title>"), inner, F.lit(tail)).alias("body"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of now(key, value) whose value's hash is new or other than before(key, hash)."""
    hashed = now.withColumn("hash", F.sha2("value", 256))
    return hashed.join(before.select("key", F.col("hash").alias("old")), "key", "left").where(F.col("old").isNull() | (F.col("old") != F.col("hash"))).drop("old")


def write_documents(docs: DataFrame, path: str) -> None:
    """One text file per feed under path/feed=...; Spark's committer renames them into place."""
    docs.select("feed", F.col("body").alias("value")).write.mode("overwrite").partitionBy("feed").text(path)
