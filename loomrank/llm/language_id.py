"""Operator 5: language ID by compression with per-language zstandard dictionaries.

For each language some labelled texts, lower-cased, become a raw-content dictionary. A text is cut into blocks of 8 KB,
every block of the whole text is compressed with every dictionary, and the language with the smallest sum
wins. The margin to the runner-up is the score; a margin under `min_margin` sets `rejected`.

Dictionaries come from a bounded sample of labelled rows: docs_per_lang different texts of the smallest hash for
each language, cut whole into passages, of which those of the smallest hash fill dict_bytes bytes (documented bounds; nothing else is sampled).

Defined results: null text and text without a letter are `und` with score 0; ties go to the language that
sorts first; a language of a few bytes is learned like any other; repeated rows get equal answers; without any labelled text everything is `und`; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.llm.common import ids_of, small_batches, table, whole_ids

BLOCK = 8192
#: Matches from four bytes on, found by lazy search: short words count, which the stock levels skip.
PARAMS = {"window_log": 17, "hash_log": 15, "chain_log": 15, "search_log": 4, "min_match": 4, "strategy": zstandard.STRATEGY_LAZY}


def held_out(doc_id="doc_id"):
    """The contract's fold: crc32 of the id as text, modulo 3, is 1. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def dictionaries(train: DataFrame, docs_per_lang: int = 96, dict_bytes: int = 48_000, passage: int = 400) -> dict[str, bytes]:
    """Raw dictionary content by language, from train(doc_id, text, lang). The driver gets at most 4 * dict_bytes / passage passages a language."""
    known = train.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    first = lambda by: F.row_number().over(Window.partitionBy("lang").orderBy(by))
    picked = known.select("lang", "h").distinct().withColumn("r", first("h")).where(F.col("r") <= docs_per_lang).drop("r")
    few = known.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"])
    cut = few.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{passage}}}"), F.lit(0))).alias("part"))
    rows = (cut.select("lang", "part", F.xxhash64("part").alias("h")).dropDuplicates(["lang", "h"])
            .withColumn("r", first("h")).where(F.col("r") <= 4 * dict_bytes // passage).collect())
    content: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        had = content.get(r["lang"], b"")
        if len(had) < dict_bytes:
            content[r["lang"]] = (had + r["part"].lower().encode("utf-8", "replace") + b"\n")[:dict_bytes]
    # a dictionary has nine bytes at least: shorter content is repeated
    return {k: v * -(-9 // len(v)) for k, v in content.items()}


def predict(docs: DataFrame, content: dict[str, bytes], min_margin: float = 0.003) -> DataFrame:
    """doc_id, lang_pred, score, rejected for docs(doc_id, text)."""
    names = sorted(content)

    def run(batches):
        made = []
        params = zstandard.ZstdCompressionParameters(**PARAMS, write_content_size=False)
        for k in names:
            d = zstandard.ZstdCompressionDict(content[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        letter = regex.compile(r"\p{L}")

        def judged(text):
            if not names or not isinstance(text, str) or not letter.search(text):
                return "und", 0.0, True
            raw = text.lower().encode("utf-8")
            blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
            sizes = [sum(len(c.compress(b)) for b in blocks) for c in made]
            best = min(range(len(names)), key=lambda i: (sizes[i], names[i]))
            rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
            margin = (rest - sizes[best]) / rest
            return names[best], min(1.0, 0.5 + 5 * margin), margin < min_margin

        for pdf in batches:
            out = [judged(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": ids_of(pdf), "held_out": pdf["held_out"], "lang_pred": [o[0] for o in out],
                                "score": [o[1] for o in out], "rejected": [o[2] for o in out]})

    small_batches(docs.sparkSession)
    return whole_ids(docs.select("doc_id", held_out().alias("held_out"), "text")).mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table; dictionaries from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, dictionaries(docs.where(~held_out()).select("doc_id", "text", "lang")))
