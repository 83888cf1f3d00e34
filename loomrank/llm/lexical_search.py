"""Operator 12: ranked lexical search by sorted accumulation.

Every whole document is cut into terms once and reduced to the arrays that matter: its length, and the terms it shares with the
queries, with their counts. Corpus figures (documents, length, document frequencies) are sums over these arrays. Then each
task concatenates item, document and impact arrays of its matches, packs item and document into one key,
radix-sorts the keys 16 bits at a time, and adds up equal keys' impacts with reduceat. A heap per item keeps the
best of a task. The tasks' candidates are partitioned by ranges of (item, score), so that no item is too large for a task;
each range is reduced by heaps again, and what is left of an item, its best of each range, is ranked in a window.

Queries are read in blocks of at most BLOCK_TERMS terms (a single longer query is a block of its own), so that the vocabulary, weights
and heaps a task holds have a bound; every block goes over all documents.

Defined results: null and empty texts have no terms and are not counted as documents, an item without terms or matches has no rows; repeated documents count and rank
each; a document without an id ranks after its equals; items of equal id and text are one item, items of one id and different texts are each answered under that id;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.llm.common import park, small_batches, table, unpark

BLOCK_TERMS, BLOCK_ITEMS = 200_000, 4096
#: Impacts accumulated at a time; texts are cut into terms in pieces of about so many bytes.
TRIPLES, PIECE = 1 << 20, 1 << 20
#: Every byte that separates terms becomes a space, A-Z becomes a-z; bytes of other characters (from 128) stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    folded, at = (text or b"").translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE) if at + PIECE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _matched(vocabulary: dict[bytes, int]):
    def run(batches):
        for b in batches:
            size, counts, terms, times = [], [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                n, found = 0, Counter()
                for words in pieces(text):
                    n += len(words)
                    found.update(filter(vocabulary.__contains__, words))
                size.append(n)
                counts.append(len(found))
                terms += map(vocabulary.__getitem__, found)
                times += found.values()
            at = pa.array(np.cumsum([0, *counts]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))],
                ["doc_id", "n", "terms", "times"])

    return run


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned keys: one stable pass for each 16 bits in use (numpy sorts 16-bit numbers by radix)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(keys.max(initial=0)).bit_length(), 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


class _Best:
    """Heaps of the best (score, document) pairs of each item; equal scores prefer the smaller id, no id comes last."""

    def __init__(self, top: int):
        self.top, self.heaps = top, {}

    def floor(self, item: int) -> int:
        heap = self.heaps.get(item, ())
        return heap[0][0] if len(heap) == self.top else 1

    def add(self, item: int, scores: list[int], ids: list[int | None]) -> None:
        heap = self.heaps.setdefault(item, [])
        for score, doc in zip(scores, ids, strict=True):
            entry = (score, doc is not None, 0 if doc is None else -doc)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def batch(self) -> pa.RecordBatch:
        rows = [(item, -doc if known else None, score) for item, heap in self.heaps.items() for score, known, doc in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])


def _accumulate(start: np.ndarray, items: np.ndarray, times: np.ndarray, weight: np.ndarray, documents: int, length: int, top: int):
    """start, items, times: for each term the items that hold it, and how often, one term after another."""
    def scores(docs: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray):
        """(item, doc, score) arrays in order of item and doc."""
        impact = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
        fan = start[terms + 1] - start[terms]
        at = np.repeat(start[terms] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
        keys = items[at].astype(np.uint64) << np.uint64(32) | np.repeat(docs, fan).astype(np.uint64)
        gains, order = np.repeat(impact, fan) * times[at], radix_order(keys)
        keys = keys[order]
        first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
        return (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.add.reduceat(gains[order], first)

    def run(batches):
        best = _Best(top)
        for b in batches:
            counts = np.diff(b.column("terms").offsets.to_numpy())
            terms, tf = b.column("terms").flatten().to_numpy(), b.column("times").flatten().to_numpy()
            m = 75 + (25 * b.column("n").to_numpy() * documents) // max(1, length)
            ids, docs = b.column("doc_id"), np.repeat(np.arange(b.num_rows), counts)
            work = np.cumsum(start[terms + 1] - start[terms])
            # whole documents, up to TRIPLES impacts (unless one has more)
            ends, done = np.cumsum(counts), 0
            upto = work[ends - 1] if len(terms) else ends * 0
            upto = np.where(ends > 0, upto, 0)
            while done < b.num_rows:
                spent = upto[done - 1] if done else 0
                stop = max(done + 1, int(np.searchsorted(upto, spent + TRIPLES, "right")))
                cut = slice(ends[done - 1] if done else 0, ends[stop - 1])
                done = stop
                if cut.start == cut.stop:
                    continue
                item, doc, score = scores(docs[cut], terms[cut], tf[cut], m)
                edges = np.nonzero(np.append(True, item[1:] != item[:-1]))[0]
                for lo, hi in zip(edges, np.append(edges[1:], len(item)), strict=True):
                    s, least = score[lo:hi], best.floor(int(item[lo]))
                    if hi - lo > top:
                        least = max(least, int(np.partition(s, -top)[-top]))
                    good = lo + np.nonzero(s >= least)[0]
                    if len(good):
                        best.add(int(item[lo]), score[good].tolist(), ids.take(pa.array(doc[good])).to_pylist())
        yield best.batch()

    return run


def _select(top: int):
    def run(batches):
        best = _Best(top)
        for b in batches:
            for item, doc, score in zip(*(b.column(c).to_pylist() for c in ("item", "doc_id", "score")), strict=True):
                best.add(item, [score], [doc])
        yield best.batch()

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item_id, terms) of all items, in blocks."""
    block, size = [], 0
    for r in items.select("item_id", "text").distinct().toLocalIterator():
        terms = Counter(w for words in pieces((r["text"] or "").encode()) for w in words)
        if block and (size + len(terms) > BLOCK_TERMS or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((r["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def _search(docs: DataFrame, block: list[tuple[int | None, Counter]], top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    held = sorted((vocabulary.setdefault(w, len(vocabulary)), k, n) for k, (_, terms) in enumerate(block) for w, n in terms.items())
    matched = park(docs.select("doc_id", "text").mapInArrow(_matched(vocabulary), "doc_id long, n long, terms array<int>, times array<long>"))
    total = matched.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    start = np.searchsorted([h[0] for h in held], np.arange(len(vocabulary) + 1))
    found = matched.where(F.size("terms") > 0).mapInArrow(
        _accumulate(start, np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64), weight, total["documents"], total["length"], top), "item int, doc_id long, score long")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    kept = found.repartitionByRange(n, "item", *order).mapInArrow(_select(top), "item int, doc_id long, score long")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    # a block's ids
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item int, item_id long")
    out = park(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    unpark(matched)
    return out


def lexical_search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of docs(doc_id, text) for each item of items(item_id, text)."""
    small_batches(docs.sparkSession)
    out = None
    for block in _blocks(items):
        found = _search(docs, block, top)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items against the whole documents table."""
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS documents, sum(len(terms))::BIGINT AS length FROM d),
p AS (SELECT row, doc_id, len(terms)::BIGINT AS n, t, count(*) AS tf FROM d, unnest(terms) u(t) GROUP BY row, doc_id, terms, t),
w AS (SELECT t, floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY t, documents),
q AS (SELECT item, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark), unnest(terms) u(t) GROUP BY item, item_id, t),
s AS (SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * documents) // length))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t), total GROUP BY item, item_id, row, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
