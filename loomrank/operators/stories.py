"""Same-story signals, nearest neighbours in a time window, and clustering by best earlier match."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.functions import numbers as N
from loomrank.functions import text as X
from loomrank.operators.setjoin import bit_words, different_sets, first_from, last_until, met_sets, most_alike, set_id, set_key, similar_sets
from loomrank.plans.shared import park

# The functions that tasks run travel with them, so executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Window, title cut, cosine floor and confidence of one story; weights of the signals.
WINDOW_HOURS, TITLE_CUT, FLOOR, CUT = 96, .62, .45, .42
WEIGHT, TIME, SAME_SOURCE, ENTITY_WEIGHT, TITLE_WEIGHT = .83, .17, -.17, .55, .30


def read(items: DataFrame) -> DataFrame:
    """Tokens and entities in place of title and summary; best at the scan, so that no text goes through a join."""
    return items.withColumns({"tokens": F.array_distinct(X.tokenize(F.col("title"))), "entities": X.named_entities(F.concat_ws(" ", "title", "summary"))}).drop("title", "summary")


def prepare(items: DataFrame) -> DataFrame:
    """Tokens, entities, norm and time once per item, before any pairing; items: item_id, source_id, title and summary (or what read() gives), url, at (ms), embedding."""
    return (items if "tokens" in items.columns else read(items)).select("item_id", "source_id", "url", "at", "tokens", "entities", "embedding", N.norm(F.col("embedding")).alias("size"))


def cosine(a: str, b: str) -> Column:
    size = F.col(f"{a}.size") * F.col(f"{b}.size")
    return F.when(size > 0, N.dot(F.col(f"{a}.embedding"), F.col(f"{b}.embedding")) / size).otherwise(0.0)


def signals(pairs: DataFrame) -> DataFrame:
    """pairs with title, similarity, hours, confidence and perspective distance."""
    hours = F.abs(F.col("a.at") - F.col("b.at")) / F.lit(float(N.HOUR))
    s = pairs.withColumns({
        "same_url": F.coalesce(F.col("a.url") == F.col("b.url"), F.lit(False)), "title": X.jaccard(F.col("a.tokens"), F.col("b.tokens")),
        "similarity": F.coalesce(cosine("a", "b"), F.lit(0.0)), "hours": hours, "entity": X.jaccard(F.col("a.entities"), F.col("b.entities"))})
    vectors = F.col("a.embedding").isNotNull() & F.col("b.embedding").isNotNull()
    near = N.proximity(F.col("hours"), WINDOW_HOURS)
    own = F.when(F.col("a.source_id") == F.col("b.source_id"), SAME_SOURCE).otherwise(0.0)
    lift = F.greatest(F.lit(0.0), (F.col("similarity") - FLOOR) / (1 - FLOOR))
    confidence = (F.when(F.col("same_url"), 1.0).when(F.col("hours") > WINDOW_HOURS, 0.0)
                  .when(F.col("title") >= TITLE_CUT, F.greatest(F.lit(.9), F.col("title")))
                  .when(~vectors, N.clamp(ENTITY_WEIGHT * F.col("entity") + TITLE_WEIGHT * F.col("title") + TIME * near))
                  .otherwise(N.clamp(WEIGHT * lift + TIME * near + own)))
    apart = F.when(F.col("same_url"), 0.0).otherwise(N.clamp(
        .60 * (1 - F.col("title")) + .10 * F.greatest(F.lit(0.0), F.col("similarity") - F.col("title")) - .50 * F.col("similarity")))
    return s.withColumn("confidence", confidence).withColumn("perspective", apart)


#: Rows and columns of a tile of a matrix product inside a task.
_ROWS, _COLUMNS = 512, 4096
#: Vectors a block: blocks meet pair by pair in tasks, so a vector is sent once for each block that it may meet.
BLOCK = 16384
#: The same where only near copies are sought, components that are compared first, and the share of a tile (one in so many) from which its product is taken whole.
COPY_BLOCK, LEAD, _DENSE = 65536, 16, 64
#: The same where stories are sought, and what a product in single precision may lack.
STORY_BLOCK, _COARSE = 32768, 1e-5


def _unit(rows: pd.Series, dims: int) -> np.ndarray:
    """Vectors of length 1, filled up by 0; those without length or with values that aren't finite are 0."""
    if all(len(v) == dims for v in rows):
        e = np.array(list(rows), dtype=float).reshape(len(rows), dims)
    else:
        e = np.zeros((len(rows), dims))
        for i, v in enumerate(rows):
            e[i, :len(v)] = v
    e[~np.isfinite(e).all(axis=1)] = 0.0
    size = np.linalg.norm(e, axis=1)
    return e / np.where(size > 0, size, 1.0)[:, None]


def _tiles(at: np.ndarray, others: np.ndarray, before: int, after: int):
    """(rows, columns, whole) of both sides, each by time: tiles that hold all pairs of which the other comes at most `before` earlier and `after` later; whole if they hold no others."""
    for i in range(0, len(at), _ROWS):
        low, high = at[i], at[min(i + _ROWS, len(at)) - 1]
        begin, end = np.searchsorted(others, low - before), np.searchsorted(others, high + after, "right")
        for j in range(begin, end, _COLUMNS):
            k = min(j + _COLUMNS, end)
            yield slice(i, min(i + _ROWS, len(at))), slice(j, k), others[j] >= high - before and others[k - 1] <= low + after


def _equal_ids(ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal ids on both sides, in the first side's order."""
    met = pd.DataFrame({"id": ids, "i": np.arange(len(ids))}).merge(pd.DataFrame({"id": others, "j": np.arange(len(others))}), on="id").sort_values("i")
    return met["i"].to_numpy(), met["j"].to_numpy()


def _largest_cosines(hours: int):
    width = hours * N.HOUR

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "item_id"], kind="stable")
        first = (pdf["own"] == pdf["own"].min()).to_numpy()
        # two blocks meet crosswise, one meets itself
        left, right = (pdf[first], pdf[~first]) if not first.all() else (pdf, pdf)
        if first.all() and pdf["key"].iat[0].count(pdf["own"].iat[0]) < 2:
            return pd.DataFrame({"item_id": [], "nearest": []}).astype({"item_id": "int64", "nearest": "float64"})
        dims = max(map(len, pdf["embedding"]))
        a, b = _unit(left["embedding"], dims), _unit(right["embedding"], dims)
        at, others = left["at"].to_numpy(), right["at"].to_numpy()
        same_i, same_j = _equal_ids(left["item_id"].to_numpy(), right["item_id"].to_numpy())
        best, back = np.full(len(left), -np.inf), np.full(len(right), -np.inf)
        for r, k, whole in _tiles(at, others, width, width):
            c = a[r] @ b[k].T
            if not whole:
                c[np.abs(at[r][:, None] - others[k][None, :]) > width] = -np.inf
            i, j = (x[np.searchsorted(same_i, r.start):np.searchsorted(same_i, r.stop)] for x in (same_i, same_j))
            inside = (j >= k.start) & (j < k.stop)
            c[i[inside] - r.start, j[inside] - k.start] = -np.inf
            best[r] = np.maximum(best[r], c.max(1))
            if left is not right:
                back[k] = np.maximum(back[k], c.max(0))
        found = pd.DataFrame({"item_id": left["item_id"].to_numpy(), "nearest": best})
        if left is not right:
            found = pd.concat([found, pd.DataFrame({"item_id": right["item_id"].to_numpy(), "nearest": back})])
        return found[found["nearest"] > -np.inf]

    return run


def _met(items: DataFrame, hours: int, block: int, *further: str) -> DataFrame:
    """Rows with vectors, once for each pair of blocks (key) in which they meet others of the window; `own` is a row's block.

    Time buckets as wide as the window are cut into blocks of about `block` items; a block meets itself and the blocks of its own and the adjacent buckets.
    """
    known = (items.where("embedding IS NOT NULL").select("item_id", "at", "embedding", *further)
             .withColumn("bucket", F.floor(F.col("at") / (hours * N.HOUR)).cast("long")))
    sizes = known.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    around = [sizes.select((F.col("bucket") - k).alias("bucket"), F.lit(k).alias("k"), F.col("blocks").alias("theirs")) for k in (-1, 0, 1)]
    meets = around[0].unionByName(around[1]).unionByName(around[2])
    name = lambda bucket, no: F.concat(F.lit("<"), bucket.cast("string"), F.lit(":"), no.cast("string"), F.lit(">"))
    placed = known.join(sizes, "bucket").withColumn("own", name(F.col("bucket"), F.pmod(F.xxhash64("item_id"), F.col("blocks"))))
    return (placed.join(meets, "bucket").withColumn("no", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
            .withColumn("other", name(F.col("bucket") + F.col("k"), F.col("no")))
            .select("item_id", "at", "embedding", *further, "own", F.concat(F.least("own", "other"), F.greatest("own", "other")).alias("key")))


def nearest(items: DataFrame, hours: int = WINDOW_HOURS, block: int = BLOCK) -> DataFrame:
    """item_id, nearest: the largest cosine to an item with a vector in the window, 0 at least.

    Blocks meet pair by pair, tile by tile of a matrix product, by time. So a busy week is spread over many tasks, no vector travels with a pair, and nothing is approximate.
    """
    return (_met(items, hours, block).groupBy("key").applyInPandas(_largest_cosines(hours), "item_id long, nearest double")
            .groupBy("item_id").agg(F.greatest(F.lit(0.0), F.max("nearest")).alias("nearest")))


def _near_copies(hours: int, cut: float):
    width = hours * N.HOUR

    def leads(e: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """A few turned components and the length of the rest: the product of two such rows is no smaller than that of the vectors."""
        lead = e @ turn
        rest = np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", e, e) - np.einsum("ij,ij->i", lead, lead)))
        return np.column_stack([lead, rest]).astype("float32")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "item_id"], kind="stable")
        first = (pdf["own"] == pdf["own"].min()).to_numpy()
        left, right = (pdf[first], pdf[~first]) if not first.all() else (pdf, pdf)
        if first.all() and pdf["key"].iat[0].count(pdf["own"].iat[0]) < 2:
            return pd.DataFrame({"item_id": [], "nearest": []}).astype({"item_id": "int64", "nearest": "float64"})
        dims = max(map(len, pdf["embedding"]))
        a = _unit(left["embedding"], dims)
        b = a if left is right else _unit(right["embedding"], dims)
        turn = np.linalg.qr(np.random.default_rng(0).standard_normal((dims, dims)))[0][:, :LEAD]
        mine, theirs = leads(a, turn), leads(b, turn)
        at, others, ids, other_ids = left["at"].to_numpy(), right["at"].to_numpy(), left["item_id"].to_numpy(), right["item_id"].to_numpy()
        best = np.full(len(left), -np.inf)
        back = best if left is right else np.full(len(right), -np.inf)
        for r, k, _ in _tiles(at, others, width, width):
            # a block that meets itself has its pairs on one side of the diagonal
            if left is right and k.stop <= r.start:
                continue
            open_i, open_j = best[r] < cut, back[k] < cut
            if not open_i.any() and not open_j.any():
                continue
            i, j = np.nonzero(mine[r] @ theirs[k].T >= cut - 1e-4)
            keep = open_i[i] | open_j[j]
            i, j = i[keep] + r.start, j[keep] + k.start
            keep = (np.abs(at[i] - others[j]) <= width) & (ids[i] != other_ids[j])
            i, j = i[keep], j[keep]
            # many candidates: one product of the tile costs less than theirs one by one
            whole = a[r] @ b[k].T if len(i) * _DENSE > (r.stop - r.start) * (k.stop - k.start) else None
            c = np.einsum("ij,ij->i", a[i], b[j]) if whole is None else whole[i - r.start, j - k.start]
            i, j, c = i[c >= cut], j[c >= cut], c[c >= cut]
            np.maximum.at(best, i, c)
            np.maximum.at(back, j, c)
        found = pd.DataFrame({"item_id": ids, "nearest": best})
        if left is not right:
            found = pd.concat([found, pd.DataFrame({"item_id": other_ids, "nearest": back})])
        return found[found["nearest"] > -np.inf]

    return run


def near_copies(items: DataFrame, cut: float, hours: int = WINDOW_HOURS, block: int = COPY_BLOCK) -> DataFrame:
    """item_id, nearest: a cosine of `cut` (above 0) or more to another item in the window, for each item that has one; not always the largest.

    As nearest(), but all pairs meet only with a few components and the length of the rest, whose product is an upper bound; vectors are multiplied where it reaches the cut, and
    not for pairs of items that both have a copy already. Nothing is approximate.
    """
    return (_met(items, hours, block).groupBy("key").applyInPandas(_near_copies(hours, cut), "item_id long, nearest double")
            .groupBy("item_id").agg(F.max("nearest").alias("nearest")))


#: Entities this much alike are searched by entities, pairs below by titles; it divides the work between two searches and changes no result.
ENTITY_FLOOR = .3
#: Decimal places at which confidences count as equal.
_PLACES = 12
_SEPARATOR = "\x1f"
FOUND = "item_id long, confidence double, new boolean, at long, found long"


def keyed(prepared: DataFrame) -> DataFrame:
    """prepare()'s rows with one string each for the title's and the entities' set."""
    return prepared.withColumns({"title_key": set_key(F.col("tokens")), "entity_key": set_key(F.col("entities"))})


def _earliest(sides: dict[bool, DataFrame], asks: DataFrame, width: int) -> DataFrame:
    """For asks(item_id, at, key, confidence), the first row of either side with that title in the window around `at` that comes before it."""
    events = [d.where("title_key IS NOT NULL").select(F.struct(F.lit(new).alias("new"), F.col("title_key").alias("key")).alias("key"), "at", F.col("item_id").alias("id")) for new, d in sides.items()]
    asked = [asks.select(F.struct("item_id", "at", "confidence", F.lit(new).alias("new")).alias("ask"), F.struct(F.lit(new).alias("new"), "key").alias("key"), (F.col("at") - width).alias("at")) for new in sides]
    found = first_from(reduce(DataFrame.union, asked), reduce(DataFrame.union, events)).where("found IS NOT NULL")
    return _before(found.select(F.col("ask.item_id").alias("item_id"), F.col("ask.at").alias("own"), F.col("ask.confidence").alias("confidence"), F.col("ask.new").alias("new"), F.col("found_at").alias("at"), "found"), width)


def _before(found: DataFrame, width: int) -> DataFrame:
    """Of (item_id, own, confidence, new, at, found): those inside the window that come before the item; whatever is stored does."""
    earlier = ~F.col("new") | (F.struct("at", F.col("found")) < F.struct(F.col("own"), F.col("item_id")))
    return found.where((F.abs(F.col("at") - F.col("own")) <= width) & earlier).select("item_id", "confidence", "new", "at", "found")


def _vector_pairs(a: pd.DataFrame, b: pd.DataFrame, width: int, cut: float, every: bool = False):
    """By tile the places and confidences of pairs of asking rows and candidates, each by time and id, that reach the cut and whose titles don't decide by themselves.

    every: later candidates count too; rows that meet themselves give each pair once.
    """
    if not len(a) or not len(b):
        return
    dims = max(max(map(len, a["embedding"])), max(map(len, b["embedding"])))
    mine = _unit(a["embedding"], dims)
    theirs = mine if a is b else _unit(b["embedding"], dims)
    coarse, coarse_b = mine.astype("float32"), theirs.astype("float32")
    at, others, ids, other_ids = a["at"].to_numpy(), b["at"].to_numpy(), a["item_id"].to_numpy(), b["item_id"].to_numpy()
    new = np.ones(len(b), dtype=bool) if every else b["new"].to_numpy(dtype=bool)
    sources = pd.factorize(pd.concat([a["source_id"], b["source_id"]]))[0]
    source, their_source = sources[:len(a)], sources[len(a):]
    # titles that are similar decide by themselves, elsewhere
    titles, title = np.unique(b["title"].fillna(0).to_numpy(dtype="int64"), return_inverse=True)
    skipped = [(i, t) for i, skip in enumerate(a["skip"]) if skip is not None for t in skip]
    skip = np.array(skipped, dtype="int64").reshape(-1, 2)
    place = np.minimum(np.searchsorted(titles, skip[:, 1]), len(titles) - 1)
    known = titles[place] == skip[:, 1]
    skip = skip[known, 0] * len(titles) + place[known]
    # what cosine the cut needs at the same time
    least = FLOOR + (cut - TIME) / WEIGHT * (1 - FLOOR) - 1e-9 if cut > TIME else -np.inf
    for r, k, _ in _tiles(at, others, width, 0 if new.all() and not every else width):
        if a is b and every and k.stop <= r.start:
            continue
        # single precision finds the pairs, double precision decides
        i, j = np.nonzero(coarse[r] @ coarse_b[k].T >= least - _COARSE)
        i, j = i + r.start, j + k.start
        gap = np.abs(at[i] - others[j])
        later = (others[j] > at[i]) | ((others[j] == at[i]) & (other_ids[j] >= ids[i]))
        keep = (gap <= width) & ((i < j if a is b else ids[i] != other_ids[j]) if every else ~(later & new[j]))
        i, j, gap = i[keep], j[keep], gap[keep]
        s = np.einsum("ij,ij->i", mine[i], theirs[j])
        c = WEIGHT * np.maximum(0.0, (s - FLOOR) / (1 - FLOOR)) + TIME * (1 - gap / width)
        c = np.round(np.clip(c + np.where((source[i] == their_source[j]) & (source[i] >= 0), SAME_SOURCE, 0.0), 0.0, 1.0), _PLACES)
        keep = (s >= least) & (c >= cut)
        i, j, c = i[keep], j[keep], c[keep]
        keep = ~np.isin(i * len(titles) + title[j], skip)
        yield i[keep], j[keep], c[keep]


def _vector_best(width: int, cut: float):
    """Per task: one block of items that ask against one block of candidates, tile by tile of a matrix product."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["asks"] == asks].sort_values(["at", "item_id"], kind="stable").reset_index(drop=True) for asks in (True, False))
        best, top = np.full(len(a), -1), np.full(len(a), -1.0)
        # what is stored comes first, then by time and id
        place = np.lexsort((b["item_id"], b["at"], b["new"]))
        rank = np.empty(len(b), dtype="int64")
        rank[place] = np.arange(len(b))
        for i, j, c in _vector_pairs(a, b, width, cut):
            order = np.lexsort((rank[j], -c, i))
            i, j, c = i[order], j[order], c[order]
            first = np.append(True, i[1:] != i[:-1])[:len(i)]
            i, j, c = i[first], j[first], c[first]
            better = (c > top[i]) | ((c == top[i]) & (rank[j] < rank[best[i]]))
            best[i[better]], top[i[better]] = j[better], c[better]
        k = np.nonzero(best >= 0)[0]
        return pd.DataFrame({"item_id": a["item_id"].to_numpy()[k], "confidence": top[k], "new": b["new"].to_numpy()[best[k]], "at": b["at"].to_numpy()[best[k]], "found": b["item_id"].to_numpy()[best[k]]})

    return run


def _skipped(asking: DataFrame, theirs: DataFrame, similar: DataFrame) -> DataFrame:
    """title_key, skip: titles of rows with vectors, each with hashes of those of theirs that are similar."""
    titled = lambda d, c: d.where("embedding IS NOT NULL").select(F.col("title_key").alias(c)).distinct()
    known = similar.join(titled(theirs, "right_key"), "right_key", "left_semi").join(titled(asking, "left_key"), "left_key", "left_semi")
    return known.groupBy(F.col("left_key").alias("title_key")).agg(F.collect_set(F.xxhash64("right_key")).alias("skip"))


def _vector_blocks(asking: DataFrame, sides: dict[bool, DataFrame], similar: DataFrame, width: int, block: int = STORY_BLOCK) -> DataFrame:
    """Rows with vectors, once for each block of the other side that they may meet, by key. The blocks of a window meet."""
    bucket = F.floor(F.col("at") / width).cast("long").alias("bucket")
    skip = _skipped(asking, reduce(DataFrame.unionByName, [d.select("title_key", "embedding") for d in sides.values()]), similar)
    columns = ["item_id", "source_id", "at", "embedding", F.xxhash64("title_key").alias("title")]
    a = asking.where("embedding IS NOT NULL").join(skip, "title_key", "left").select(*columns, "skip", F.lit(True).alias("new"), F.lit(True).alias("asks"), bucket)
    b = reduce(DataFrame.unionByName, [d.where("embedding IS NOT NULL").select(*columns, F.lit(None).cast("array<bigint>").alias("skip"), F.lit(new).alias("new"), F.lit(False).alias("asks"), bucket) for new, d in sides.items()])
    blocks = lambda d: d.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    a_blocks, b_blocks = blocks(a), blocks(b)

    def placed(d, own, others, around, key):
        d = d.join(own.toDF("bucket", "mine"), "bucket").withColumn("no", F.pmod(F.xxhash64("item_id"), F.col("mine"))).withColumn("there", F.explode(F.array(*[F.col("bucket") + k for k in around])))
        d = d.join(others.toDF("there", "theirs"), "there").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
        return d.select("item_id", "source_id", "at", "embedding", "title", "skip", "new", "asks", F.concat_ws("/", *key).alias("key"))

    # new rows follow earlier ones only, stored ones lie on both sides
    around = (-1, 0, 1) if False in sides else (-1, 0)
    return (placed(a, a_blocks, b_blocks, around, ("bucket", "no", "there", "other"))
            .unionByName(placed(b, b_blocks, a_blocks, [-k for k in around], ("there", "other", "bucket", "no"))))


def _by_vector(asking: DataFrame, sides: dict[bool, DataFrame], similar: DataFrame, width: int, cut: float) -> DataFrame:
    """The best candidate with a vector for each asking item with one. An item leaves a block with one row at most."""
    return _vector_blocks(asking, sides, similar, width).groupBy("key").applyInPandas(_vector_best(width, cut), FOUND)


def _profile(new: Column) -> Column:
    """What stands for the profile of a row: title, entities, vector or not, stored or new."""
    return set_id(F.to_json(F.struct(F.col("title_key"), F.col("entity_key"), F.col("embedding").isNull().alias("bare"), new.alias("new"))))


#: Longs of bits for a profile's title and its entities, and profiles of one title that one row meets at once.
_TITLE_WORDS, _ENTITY_WORDS, _SOME = 2, 4, 1024


def _profiles(rows: DataFrame) -> DataFrame:
    """Each different profile of rows(item_id, at, title_key, entity_key, embedding, new) once: its sets, their sizes and bits, its first and last time, and its rows (`one`: the only row)."""
    known = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, _SEPARATOR))
    alike = (rows.groupBy("title_key", "entity_key", F.col("embedding").isNull().alias("bare"), "new")
             .agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("rows"), F.min("item_id").alias("one")))
    told = alike.select(set_id(F.to_json(F.struct("title_key", "entity_key", "bare", "new"))).alias("id"), set_id(F.col("title_key")).alias("title"), known("title_key").alias("tokens"), known("entity_key").alias("entities"),
                        "bare", "new", "lo", "hi", "rows", "one")
    return told.select("*", F.size("tokens").alias("tn"), F.size("entities").alias("en"), *[x.alias(f"tw{w}") for w, x in enumerate(bit_words(F.col("tokens"), _TITLE_WORDS))],
                       *[x.alias(f"ew{w}") for w, x in enumerate(bit_words(F.col("entities"), _ENTITY_WORDS))])


def _profile_pairs(mine: DataFrame, theirs: DataFrame, cut: float, checkpoint, every: bool = False) -> DataFrame:
    """Pairs of _profiles(), one of them without vector, that reach the cut without similar titles at some times of theirs: a_ and b_ id, new, lo, hi, rows, one, with base.

    Those meet whose entities are alike by ENTITY_FLOOR, and those below whose titles are alike by what the cut needs beside such entities. No other pair can
    reach the cut. The first meet by tokens of their entities. For the second, different titles meet, and then the profiles of two titles, some at once. In both,
    lengths and bits of both sets and the times bound what a pair can reach before it is written anywhere; its tokens decide. every: both sides are the same,
    each pair comes once and times may lie either way; else new rows of theirs come before mine.
    """
    width = WINDOW_HOURS * N.HOUR

    def in_time(base: Column, a: str, b: str) -> Column:
        gap = F.greatest(F.lit(0), F.col(f"{b}_lo") - F.col(f"{a}_hi"), F.col(f"{a}_lo") - F.col(f"{b}_hi"))
        inside = (gap <= width) & (base + TIME * (1 - gap / width) >= cut - 1e-9)
        return inside if every else inside & (~F.col(f"{b}_new") | (F.col(f"{b}_lo") <= F.col(f"{a}_hi")))

    def most(a: str, b: str, size: str, word: str, words: int) -> Column:
        return most_alike(F.col(f"{a}_{size}"), F.col(f"{b}_{size}"), *[[F.col(f"{p}_{word}{w}") for w in range(words)] for p in (a, b)])

    once = (lambda a, b: F.col(a) <= F.col(b)) if every else lambda a, b: F.lit(True)
    bare = lambda a, b: F.col(f"{a}_bare") | F.col(f"{b}_bare")
    titled, told = [f"tw{w}" for w in range(_TITLE_WORDS)], [f"ew{w}" for w in range(_ENTITY_WORDS)]
    # alike entities: profiles meet
    narrow = ["bare", "new", "lo", "hi", F.xxhash64("title").alias("title"), "tn", *titled]
    by_entity = checkpoint(met_sets(*[d.where("en > 0").select("id", F.col("entities").alias("tokens"), *narrow) for d in (mine, theirs)], ENTITY_FLOOR, lambda alike: (
        once("left_id", "right_id") & bare("left", "right") & ((F.col("left_title") != F.col("right_title")) | (F.col("left_tn") == 0))
        & in_time(ENTITY_WEIGHT * alike + TITLE_WEIGHT * F.least(F.lit(TITLE_CUT), most("left", "right", "tn", "tw", _TITLE_WORDS)), "left", "right"))))
    # alike titles and less alike entities: titles meet, each with what is common to its profiles
    with_entities = "en > 0" if TITLE_WEIGHT * TITLE_CUT + TIME < cut - 1e-9 else "true"
    titles = [checkpoint(d.where("title IS NOT NULL").where(with_entities).groupBy(F.col("title").alias("id"), "tokens").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("k"), F.max("en").alias("en"), F.bool_or("bare").alias("bare"), F.bool_and("new").alias("new"),
        *[F.bit_or(w).alias(w) for w in told])) for d in (mine, theirs)]
    single = (F.col("left_k") == 1) & (F.col("right_k") == 1)
    apart = reduce(Column.__and__, [F.col(f"left_{w}").bitwiseAND(F.col(f"right_{w}")) == 0 for w in told])
    entity = F.least(F.lit(ENTITY_FLOOR), F.when(single, most("left", "right", "en", "ew", _ENTITY_WORDS)).when(apart, 0.0).otherwise(1.0))
    floor = (cut - TIME - ENTITY_WEIGHT * ENTITY_FLOOR) / TITLE_WEIGHT
    met = met_sets(*titles, floor, lambda alike: (once("left_id", "right_id") & (F.col("left_id") != F.col("right_id")) & bare("left", "right")
                                                 & in_time(ENTITY_WEIGHT * entity + TITLE_WEIGHT * F.least(F.lit(TITLE_CUT), alike), "left", "right")))
    side = lambda d, p, columns: d.select(F.xxhash64("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    near = (met.join(side(titles[0], "left", ("tokens",)), "left_id").join(side(titles[1], "right", ("tokens", "k")), "right_id")
            .withColumn("alike", X.jaccard(F.col("left_tokens"), F.col("right_tokens"))).where((F.col("alike") >= floor - 1e-9) & (F.col("alike") < TITLE_CUT))
            .select("left_id", "right_id", "alike", F.ceil(F.col("right_k") / _SOME).cast("int").alias("parts")))
    held = ("bare", "new", "lo", "hi", "title", "en", *told)
    parts = titles[1].select(F.xxhash64("id").alias("b_title"), F.ceil(F.col("k") / _SOME).cast("int").alias("parts"))
    some = side(theirs.where("title IS NOT NULL").where(with_entities).withColumn("title", F.xxhash64("title")), "b", held).join(parts, "b_title").withColumn("part", F.pmod(F.col("b_id"), F.col("parts")).cast("int")).drop("parts")
    asking = near.join(side(mine.where("title IS NOT NULL").where(with_entities).withColumn("title", F.xxhash64("title")), "a", held), F.col("left_id") == F.col("a_title")).drop("left_id", "a_title").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    by_title = (asking.join(some.withColumnRenamed("b_title", "right_id"), ["right_id", "part"])
                .where(bare("a", "b") & in_time(ENTITY_WEIGHT * F.least(F.lit(ENTITY_FLOOR), most("a", "b", "en", "ew", _ENTITY_WORDS)) + TITLE_WEIGHT * F.col("alike"), "a", "b")).select("a_id", "b_id"))
    pairs = checkpoint(by_entity.toDF("a_id", "b_id").withColumn("by_entity", F.lit(True)).unionByName(by_title.withColumn("by_entity", F.lit(False))))
    columns = ("tokens", "entities", "bare", "new", "lo", "hi", "rows", "one")
    whole = lambda d, p: side(d.withColumn("whole", F.col("id")), p, ("whole", *columns))
    return (pairs.join(whole(mine, "a"), "a_id").join(whole(theirs, "b"), "b_id").where(once("a_whole", "b_whole") | (F.col("a_id") != F.col("b_id")))
            .withColumns({"title": X.jaccard(F.col("a_tokens"), F.col("b_tokens")), "entity": X.jaccard(F.col("a_entities"), F.col("b_entities"))})
            .withColumn("base", ENTITY_WEIGHT * F.col("entity") + TITLE_WEIGHT * F.col("title"))
            .where((F.col("by_entity") == (F.col("entity") >= ENTITY_FLOOR)) & (F.col("title") < TITLE_CUT) & in_time(F.col("base"), "a", "b"))
            .select(*[F.col(f"{p}_whole").alias(f"{p}_id") for p in "ab"], *[f"{p}_{c}" for p in "ab" for c in ("new", "lo", "hi", "rows", "one")], "base"))


def _without_vector(asking: DataFrame, sides: dict[bool, DataFrame], width: int, cut: float, checkpoint) -> DataFrame:
    """The best candidate where either side has no vector: entities and titles decide, and of equal profiles the one nearest in time.

    Profiles (title, entities, vector or not) meet, not rows. A profile of one row is that row; of others as-of joins find the one. What those ask is written down first: the plan would hold its searches six times.
    """
    rows = lambda d, new: d.select("item_id", "at", "title_key", "entity_key", "embedding", F.lit(new).alias("new"))
    every = reduce(DataFrame.union, [rows(d, new) for new, d in sides.items()])
    mine, theirs = checkpoint(_profiles(rows(asking, True))), checkpoint(_profiles(every))
    pairs = _profile_pairs(mine, theirs, cut, checkpoint)
    own = asking.select("item_id", "at", _profile(F.lit(True)).alias("a_id"))
    asks = checkpoint(own.join(pairs, "a_id").select(F.struct("item_id", "at", "base", F.col("b_new").alias("new")).alias("ask"), F.col("b_id").alias("key"), "at", F.col("b_lo").alias("found_at"), F.col("b_rows").alias("rows"), F.col("b_one").alias("found")))
    alone = asks.where("rows = 1").select("ask", "key", "at", "found_at", "found")
    asked, events = asks.where("rows > 1").select("ask", "key", "at"), every.select(_profile(F.col("new")).alias("key"), "at", F.col("item_id").alias("id"))
    # the item itself may be the last at its own time: then the one before it counts
    around = [last_until(asked, events), last_until(asked.where("ask.new").withColumn("at", F.col("at") - 1), events), *([first_from(asked.where("NOT ask.new"), events)] if False in sides else [])]
    found = reduce(DataFrame.unionByName, [alone, *map(checkpoint, around)]).where("found IS NOT NULL")
    near = N.proximity(F.abs(F.col("found_at") - F.col("ask.at")) / F.lit(float(N.HOUR)), width / N.HOUR)
    return _before(found.select(F.col("ask.item_id").alias("item_id"), F.col("ask.at").alias("own"), F.round(N.clamp(F.col("ask.base") + TIME * near), _PLACES).alias("confidence"),
                                F.col("ask.new").alias("new"), F.col("found_at").alias("at"), "found"), width).where(F.col("confidence") >= cut)


def _rows_around(asks: DataFrame, rows: DataFrame, checkpoint) -> DataFrame:
    """ask, n: for asks(ask, key, at, reach) the number of rows(key, at) of these keys at most `reach` away, added up by ask.

    A key's rows are counted up by time, and two as-of joins give what lies between; rows of one key and time are one.
    """
    upwards = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    events = rows.groupBy("key", "at").agg(F.count("*").alias("n")).select("key", "at", F.sum("n").over(upwards).alias("id"))
    ends = F.explode(F.array(F.struct(F.lit(1).alias("sign"), (F.col("at") + F.col("reach")).alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col("at") - F.col("reach") - 1).alias("at"))))
    asked = checkpoint(asks.select("ask", "key", ends.alias("end")).select(F.struct("ask", "end.sign").alias("ask"), "key", "end.at"))
    return checkpoint(last_until(asked, events).groupBy("ask.ask").agg(F.sum(F.col("ask.sign") * F.coalesce("found", F.lit(0))).alias("n")))


def _vector_links(width: int, cut: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "item_id"], kind="stable")
        first = (pdf["own"] == pdf["own"].min()).to_numpy()
        # two blocks meet crosswise, one meets itself
        if first.all():
            a = b = pdf.reset_index(drop=True)
            if pdf["key"].iat[0].count(pdf["own"].iat[0]) < 2:
                return pd.DataFrame({"item_id": [], "n": []}).astype({"item_id": "int64", "n": "int64"})
        else:
            a, b = pdf[first].reset_index(drop=True), pdf[~first].reset_index(drop=True)
        n = np.zeros(len(a), dtype="int64")
        back = n if a is b else np.zeros(len(b), dtype="int64")
        for i, j, _ in _vector_pairs(a, b, width, cut, every=True):
            n += np.bincount(i, minlength=len(a))
            back += np.bincount(j, minlength=len(b))
        found = pd.DataFrame({"item_id": a["item_id"], "n": n})
        if a is not b:
            found = pd.concat([found, pd.DataFrame({"item_id": b["item_id"], "n": back})])
        return found[found["n"] > 0]

    return run


def link_counts(items: DataFrame, cut: float = CUT, checkpoint=park) -> DataFrame:
    """item_id, class_id, links: how many others tell the same story as an item (confidence >= cut within the window), and the smallest id among its copies
    (equal title tokens, entities and vector). Urls aren't looked at.

    Every pair of items counts, but none is listed: similar titles, and profiles that reach the cut without vectors, are pairs of different sets whose rows are
    counted by time; vectors are counted inside tiles of a matrix product. item_id must be unique.
    """
    width, cut = WINDOW_HOURS * N.HOUR, cut - 1e-9
    ready = checkpoint(keyed(prepare(items)))
    titles = different_sets(ready, "title_key")
    similar = checkpoint(similar_sets(titles, titles, TITLE_CUT))
    placed = ready.where("title_key IS NOT NULL").select(set_id(F.col("title_key")).alias("title"), "at")
    asks = placed.distinct().join(similar.select(set_id(F.col("left_key")).alias("title"), set_id(F.col("right_key")).alias("key")), "title")
    by_title = _rows_around(asks.select(F.struct("title", "at").alias("ask"), "key", "at", F.lit(width).alias("reach")), placed.withColumnRenamed("title", "key"), checkpoint)
    profile = _profile(F.lit(True))
    profiles = checkpoint(_profiles(ready.withColumn("new", F.lit(True))))
    reach = F.least(F.lit(width), F.floor(width * (1 - (cut - F.col("base")) / TIME))).cast("long")
    pairs = checkpoint(_profile_pairs(profiles, profiles, cut, checkpoint, every=True).withColumn("reach", reach).where("reach >= 0"))
    # each pair both ways
    there = lambda a, b: F.struct(F.col(f"{a}_id").alias("mine"), F.col(f"{b}_id").alias("key"), F.col(f"{b}_lo").alias("lo"), F.col(f"{b}_hi").alias("hi"), F.col(f"{b}_rows").alias("rows"))
    pairs = pairs.select("reach", F.explode(F.when(F.col("a_id") == F.col("b_id"), F.array(there("a", "b"))).otherwise(F.array(there("a", "b"), there("b", "a")))).alias("p")).select("reach", "p.*")
    rows = checkpoint(ready.select(
        "item_id", set_id(F.col("title_key")).alias("title"), "at", profile.alias("profile"), (F.col("title_key").isNotNull() | (F.col("entity_key").isNotNull() & F.col("embedding").isNull())).cast("int").alias("itself"),
        F.unhex(F.sha2(F.to_json(F.struct("title_key", "entity_key", "embedding")), 256)).alias("copy")))
    asks = checkpoint(rows.select("profile", "at").distinct().join(pairs, F.col("profile") == F.col("mine")).select(F.struct("profile", "at").alias("ask"), "key", "at", "reach", "lo", "hi", "rows"))
    # all rows of a profile that stands at one time count alike
    at_once = asks.where((F.col("lo") == F.col("hi")) & (F.abs(F.col("at") - F.col("lo")) <= F.col("reach"))).select("ask", F.col("rows").alias("n"))
    by_profile = (_rows_around(asks.where("lo < hi").select("ask", "key", "at", "reach"), rows.select(F.col("profile").alias("key"), "at"), checkpoint).unionByName(at_once)
                  .groupBy("ask").agg(F.sum("n").alias("n")))
    vectors = ready.where("embedding IS NOT NULL").join(_skipped(ready, ready, similar), "title_key", "left").withColumn("title", F.xxhash64("title_key"))
    by_vector = checkpoint(_met(vectors, WINDOW_HOURS, STORY_BLOCK, "source_id", "title", "skip").groupBy("key").applyInPandas(_vector_links(width, cut), "item_id long, n long").groupBy("item_id").agg(F.sum("n").alias("vectors")))
    classes = rows.groupBy("copy").agg(F.min("item_id").alias("class_id"))
    return (rows.join(by_title.select("ask.*", F.col("n").alias("titles")), ["title", "at"], "left").join(by_profile.select("ask.*", F.col("n").alias("profiles")), ["profile", "at"], "left")
            .join(by_vector, "item_id", "left").join(classes, "copy")
            .select("item_id", "class_id", (sum(F.coalesce(c, F.lit(0)) for c in ("titles", "profiles", "vectors")) - F.col("itself")).cast("long").alias("links")))


def best_matches(new: DataFrame, old: DataFrame | None = None, cut: float = CUT, checkpoint=park) -> DataFrame:
    """item_id, confidence, new, at, found: for each row of `new` the row that its story follows, if any reaches the cut.

    Both tables as keyed(prepare()). What is stored (`old`) comes first, then new rows by time and id; of equal confidences the first counts. An equal url
    at any distance or an equal title in the window can't be surpassed, so those items are settled by as-of joins before anything is compared; a
    group of copies costs one row each. For the rest, similar titles, vectors and profiles are searched by their own means, and no pairs of rows are listed.
    """
    width = WINDOW_HOURS * N.HOUR
    sides = {True: new}
    if old is not None:
        lo, hi = new.agg(F.min("at"), F.max("at")).first()
        sides[False] = old.where(F.col("at").between((lo or 0) - width, (hi or 0) + width))
    # equal urls: the first of all
    firsts = [d.where("url IS NOT NULL").groupBy(F.col("url").alias("same")).agg(F.min(F.struct("at", F.col("item_id").alias("found"))).alias("first")).select("same", F.lit(is_new).alias("new"), "first")
              for is_new, d in ((True, new), (False, old)) if d is not None]
    linked = (new.select("item_id", "url", F.col("at").alias("own")).join(reduce(DataFrame.union, firsts), F.col("url") == F.col("same"))
              .select("item_id", "own", F.lit(1.0).alias("confidence"), "new", F.col("first.at").alias("at"), F.col("first.found").alias("found"))
              .where(~F.col("new") | (F.struct("at", "found") < F.struct("own", "item_id"))).drop("own"))
    twins = _earliest(sides, new.where("title_key IS NOT NULL").select("item_id", "at", F.col("title_key").alias("key"), F.lit(1.0).alias("confidence")), width)
    # each search has a plan of its own: together they fill the driver
    settled = checkpoint(linked).unionByName(checkpoint(twins))
    rest = checkpoint(new.join(settled.select("item_id").distinct(), "item_id", "left_anti"))
    every = reduce(DataFrame.union, [d.select("title_key") for d in sides.values()])
    similar = checkpoint(similar_sets(different_sets(rest, "title_key"), different_sets(every, "title_key"), TITLE_CUT).where("left_key <> right_key"))
    asks = rest.join(similar, F.col("title_key") == F.col("left_key")).select("item_id", "at", F.col("right_key").alias("key"), F.round(F.greatest(F.lit(.9), "jaccard"), _PLACES).alias("confidence"))
    found = [settled, checkpoint(_earliest(sides, asks, width)), checkpoint(_by_vector(rest, sides, similar, width, cut)), checkpoint(_without_vector(rest, sides, width, cut, checkpoint))]
    first = F.struct("confidence", ~F.col("new"), -F.col("at"), -F.col("found"), F.struct("confidence", "new", "at", "found").alias("match"))
    return reduce(DataFrame.unionByName, found).groupBy("item_id").agg(F.max(first)["match"].alias("match")).select("item_id", "match.*")


def assign(new: DataFrame, old: DataFrame | None = None, cut: float = CUT, checkpoint=park) -> DataFrame:
    """item_id, cluster_id, match (the followed item; null for a seed), confidence for each row of `new`; old rows carry their cluster_id and keep it.

    Matches point to stored rows or backwards in time, so roots are found by pointer doubling: about log2 of the longest chain joins.
    """
    best = checkpoint(new.select("item_id").join(best_matches(new, old, cut, checkpoint).select("item_id", "confidence", "found", F.col("new").alias("inside")), "item_id", "left"))
    label = best.where("coalesce(inside, true)").select("item_id", F.coalesce("found", "item_id").alias("cluster_id"))
    if old is not None:
        stored = best.where("NOT inside").join(old.select(F.col("item_id").alias("found"), "cluster_id"), "found").select("item_id", "cluster_id")
        label = label.unionByName(stored)
    label = checkpoint(label)
    while True:
        up = label.select(F.col("item_id").alias("via"), F.col("cluster_id").alias("root"))
        step = checkpoint(label.join(up, label.cluster_id == up.via, "left").select(
            "item_id", F.coalesce("root", "cluster_id").alias("cluster_id"), (F.coalesce("root", "cluster_id") != F.col("cluster_id")).alias("moved")))
        label = step.select("item_id", "cluster_id")
        if step.where("moved").isEmpty():
            return label.join(best.select("item_id", F.col("found").alias("match"), "confidence"), "item_id")


def clusters(items: DataFrame, cut: float = CUT, checkpoint=park) -> DataFrame:
    """item_id, cluster_id: each item joins the cluster of its best earlier match, else seeds one."""
    return assign(checkpoint(keyed(prepare(items))), None, cut, checkpoint).select("item_id", "cluster_id")


def members(items: DataFrame, cut: float = CUT, checkpoint=park) -> DataFrame:
    """One row per item as a cluster's list of members holds it: item_id, cluster_id, match, and the signals that joined them with the perspective distance (1 for a seed)."""
    ready = checkpoint(keyed(prepare(items)))
    placed = assign(ready, None, cut, checkpoint).drop("confidence")
    side = lambda p: ready.select(F.struct(*prepare(items).columns).alias(p))
    joined = placed.where("match IS NOT NULL").join(side("a"), F.col("a.item_id") == F.col("item_id")).join(side("b"), F.col("b.item_id") == F.col("match"))
    told = signals(joined).select("item_id", "cluster_id", "match", "title", "similarity", "hours", "confidence", "perspective")
    seeds = placed.where("match IS NULL").select("item_id", "cluster_id", "match", F.lit(1.0).alias("confidence"), F.lit(1.0).alias("perspective"))
    return told.unionByName(seeds, allowMissingColumns=True)
