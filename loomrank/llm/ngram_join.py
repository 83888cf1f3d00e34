"""Operator 3: n-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Texts are sets of shingles of five words. Every distinct word sequence gets one MinHash signature, read as
`trees` paths of `max_depth` values. A tree's trie is its sorted paths: rows are range-partitioned and sorted by (tree, path),
and what two neighbours' paths share is the length of the prefix at which the trie parts them. So one sort gives the candidates of
every prefix length, and neighbours suffice: all texts below a trie node stand in a row. Hot prefixes are cut by the ranges like any others.

Prefixes are matched at full depth first and shortened, all trees alike, until the target recall: the pairs met, with their
similarity as the whole signatures estimate it, say how many such pairs prefixes of that length miss
(the chance of meeting at depth d is 1 - (1 - s^d)^trees), and the worst band of similarities decides. They are never shortened below the
length at which even pairs at the threshold reach the target.

Candidates are never listed pair by pair. The same neighbours meet in many tries, so links are first contracted where they lie: ranges of
(first signature value, text) hold most links of a group, and each gives back a forest that joins what its links join, one
link fewer than it has texts, with at most nine at a text; forests are merged like that again while it pays. Their connected components are those of all links. They are cut into blocks of about `block` texts and `block_shingles` shingles at most, and every pair of blocks of a
component is verified in one task: exact intersections of whole shingle sets (64-bit shingle hashes), pairs within it counted,
not emitted. A task returns one row per text: its number of links there and the next smaller id of its linked
group. Those links are contracted in the same way, and their components are the classes. So copies cost nothing, a near-copy group that holds a third of all
texts is spread over block pairs, and no link between different texts inside a component is lost.

Defined results: texts with equal word sequences are copies: one class, not counted as links; texts of fewer than
five words have one shingle, all their words; null, empty and blank texts are copies of each other; repeated rows
are copies; rows that share an id are told apart by their text; null ids are larger than every other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm.common import SPACES, components, ids_of, park, small_batches, table, whole_ids

#: Candidates' ids are broadcast up to this many rows (40 bytes each); beyond it their texts are joined by id.
BROADCAST_ROWS = 500_000
#: At most this many word sequences count as hot, with so many copies that their rows are not gathered by digest but meet a broadcast.
HOT_DIGESTS = 100_000
#: Links that one task contracts (16 bytes each), and that it holds at once.
LINKS_A_TASK = 200_000
_BLANK = str.maketrans(dict.fromkeys(SPACES, " "))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_list(text: str | None) -> list[str]:
    return [w for w in text.translate(_BLANK).split(" ") if w] if isinstance(text, str) else []


def shingles(texts: list[list[str]], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each word list's n-word shingles."""
    code: dict[str, int] = {}  # pandas' own factorizing stops at NUL characters
    at = np.array([code.setdefault(w, len(code)) for ws in texts for w in ws], np.int64)
    h = pd.util.hash_array(np.array(list(code), dtype=object), categorize=False)[at] if code else np.empty(0, np.uint64)
    out, at = [], 0
    for ws in texts:
        own, at = h[at:at + len(ws)], at + len(ws)
        width = min(n, len(ws))
        if not width:
            out.append(np.empty(0, np.uint64))
            continue
        s = np.full(len(ws) - width + 1, width, np.uint64)
        for i in range(width):
            s = (s ^ own[i:i + len(s)]) * _MIX
            s ^= s >> np.uint64(29)
        out.append(np.unique(s))
    return out


def expected_recall(depth: int, trees: int, threshold: float) -> float:
    return 1 - (1 - threshold**depth) ** trees


def least_depth(trees: int, max_depth: int, threshold: float, recall: float) -> int:
    """The longest prefix at which pairs at the threshold reach the target: shortening goes no further."""
    depth = max_depth
    while depth > 1 and expected_recall(depth, trees, threshold) < recall:
        depth -= 1
    return depth


def search_depth(met: list[tuple[int, int, int]], values: int, trees: int, least: int, max_depth: int, threshold: float, recall: float) -> int:
    """Prefix length after shortening, from (equal values of the signatures, shared prefix, number) of the pairs met."""
    bands: dict[int, list[tuple[float, int, int]]] = {}
    for same, lcp, n in met:
        likely = same / values
        if likely >= threshold - 0.02:
            bands.setdefault(int(likely * 20), []).append((max(likely, threshold), lcp, n))
    for depth in range(max_depth, least, -1):
        worst = 1.0
        for pairs in bands.values():
            found = sum(n for _, lcp, n in pairs if lcp >= depth)
            every = sum(n / expected_recall(depth, trees, s) for s, lcp, n in pairs if lcp >= depth)
            worst = min(worst, found / every if every else 0.0)
        if worst >= recall:
            return depth
    return least


def minhashes(sets: list[np.ndarray], values: int) -> np.ndarray:
    """(text, value) 32-bit MinHash signatures; rows of empty sets are 0."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 2**63, values, dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(sets), values), ">u4")
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    turned = flat ^ (flat >> np.uint64(17))
    for k in range(values):
        out[full, k] = np.minimum.reduceat((turned * a[k]) >> np.uint64(32), starts)
    return out


def linked(sets: list[np.ndarray], threshold: float, split: int | None = None) -> np.ndarray:
    """Boolean matrix of pairs with Jaccard similarity >= threshold: among all sets, or of the first `split` against the rest."""
    m = len(sets)
    left = np.arange(m) if split is None else np.arange(split)
    right = np.arange(m) if split is None else np.arange(split, m)
    size = np.array([len(s) for s in sets])
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    shared = n[code] > 1
    code, owner = code[shared], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    code = np.cumsum(np.diff(code, prepend=code[:1]) > 0) if len(code) else code
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        span = slice(*np.searchsorted(code, [first, first + 4096]))
        x = np.zeros((m, 4096), np.float32)
        x[owner[span], code[span] - first] = 1
        common += x[left] @ x[right].T
    union = size[left][:, None] + size[right][None, :] - common
    yes = (common > 0) & (common >= threshold * union - 1e-6)
    if split is None:
        np.fill_diagonal(yes, False)
    return yes


def _chain(ids: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each row the next smaller id of its group, or its own where it is the smallest: chains instead of stars, so that no id meets all others."""
    order = np.lexsort((ids, low))
    out = ids.copy()
    inner = np.nonzero(low[order][1:] == low[order][:-1])[0] + 1
    out[order[inner]] = ids[order[inner - 1]]
    return out


def _roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest id of each row's group under the links a[i]-b[i] (row numbers)."""
    low = ids.copy()
    while True:
        was = low.copy()
        np.minimum.at(low, a, was[b])
        np.minimum.at(low, b, was[a])
        if (low == was).all():
            return low


def _groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number of each row's group under the links a[i]-b[i]: roots are hooked to smaller ones and paths halved, so long chains take few rounds."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            return low
        least = np.minimum(x, y)
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        while (low[low] != low).any():
            low = low[low]


def forest(a: np.ndarray, b: np.ndarray, fan: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (id, smaller id, smallest of the group) that join the same ids as the links a[i]-b[i]: a tree a group, each id with at most `fan` children, the smallest at the root."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = _groups(len(ids), at[:len(a)], at[len(a):])
    order = np.argsort(low, kind="stable")  # by group, ids ascending
    new = np.diff(low[order], prepend=-1) != 0
    start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    parent = start + (np.arange(len(ids)) - start - 1) // fan
    return ids[order][~new], ids[order][parent[~new]], ids[order][start[~new]]


def _contract(held: int = LINKS_A_TASK):
    """Forests of a partition's links (a, b), with the root as home; about `held` links are in memory, what then still is more than half of it goes out."""
    def out(kept):
        found = forest(*map(np.concatenate, zip(*kept, strict=True)))
        return pd.DataFrame(dict(zip(("a", "b", "home"), found, strict=True)))

    def run(batches):
        kept, n = [], 0
        for pdf in batches:
            kept.append((pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)))
            n += len(pdf)
            if n >= held:
                done = out(kept)
                kept, n = [(done["a"].to_numpy(), done["b"].to_numpy())], len(done)
                if n > held // 2:
                    yield done
                    kept, n = [], 0
        if n:
            yield out(kept)

    return run


def contracted(pairs: DataFrame, links: int, a_task: int = LINKS_A_TASK) -> DataFrame:
    """Parked links (a, b), fewer than pairs(a, b, home) but with the same components; `links` is the number of pairs.

    Tasks of `a_task` links leave their forests, which meet again, by root, in as many fewer tasks as they then fill. That ends when it wouldn't halve the tasks:
    a group too large for one task keeps some links more than it has texts.
    """
    tasks = max(8, -(-links // a_task))
    while True:
        pairs = park(pairs.repartitionByRange(tasks, "home", "a").select("a", "b").mapInPandas(_contract(a_task), "a long, b long, home long"))
        fewer = max(1, -(-pairs.count() // a_task))
        if 2 * fewer > tasks:
            return pairs.select("a", "b")
        tasks = fewer


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["comp", "i", "j"], sort=False):
            g = g.assign(second=g["block"] != g["i"]).sort_values(["second", "id"], kind="stable")
            split = None if g["i"].iat[0] == g["j"].iat[0] else int((~g["second"]).sum())
            if len(g) < 2 or split in (0, len(g)):
                continue
            ids = g["id"].to_numpy()
            yes = linked(shingles([word_list(t) for t in g["text"]]), threshold, split)
            a, b = np.nonzero(yes)
            count = yes.sum(1) if split is None else np.concatenate([yes.sum(1), yes.sum(0)])
            low = _roots(ids, a, b + (split or 0))
            out.append(pd.DataFrame({"id": ids, "n_links": count, "peer": _chain(ids, low), "comp": g["comp"].iat[0]})[count > 0])
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n_links": [], "peer": [], "comp": []}, dtype="int64")

    return run


def tag_of(text: str = "text") -> Column:
    """A number that tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def signatures(docs: DataFrame, values: int) -> DataFrame:
    """doc_id, tag, digest of the word sequence, sig (4 bytes a value; null without words), size (number of shingles)."""
    def run(batches):
        for pdf in batches:
            lists = [word_list(t) for t in pdf["text"]]
            sets = shingles(lists)
            sig = minhashes(sets, values)
            yield pd.DataFrame({
                "doc_id": ids_of(pdf), "tag": pdf["tag"], "sig": [k.tobytes() if ws else None for k, ws in zip(sig, lists, strict=True)],
                "digest": [hashlib.blake2b(" ".join(ws).encode("utf-8"), digest_size=16).digest() for ws in lists], "size": [len(s) for s in sets]})

    small_batches(docs.sparkSession, size=4 << 20)
    return whole_ids(docs.select("doc_id", "text", tag_of().alias("tag"))).mapInPandas(run, "doc_id long, tag long, sig binary, digest binary, size long")


def _neighbours(least: int):
    """(a, b, lcp, home of a) of rows (tree, path, node, home) that follow each other in a tree and share `least` values or more; the partition's first and last row with lcp -1."""
    def run(batches):
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            tree, node, home = (pdf[c].to_numpy(np.int64) for c in ("tree", "node", "home"))
            path = np.frombuffer(b"".join(pdf["path"]), ">u4").reshape(len(pdf), -1)
            if last is None:
                yield pd.DataFrame({"a": [node[0]], "b": [node[0]], "lcp": [-1], "home": [home[0]], "tree": [tree[0]], "path": [path[0].tobytes()]})
            else:
                tree, node, home, path = np.append(last[0], tree), np.append(last[1], node), np.append(last[2], home), np.vstack([last[3], path])
            last = tree[-1:], node[-1:], home[-1:], path[-1:]
            lcp = np.logical_and.accumulate(path[1:] == path[:-1], axis=1).sum(1)
            lcp[tree[1:] != tree[:-1]] = 0
            k = np.nonzero(lcp >= least)[0]
            yield pd.DataFrame({"a": node[k], "b": node[k + 1], "lcp": lcp[k], "home": home[k], "tree": tree[k], "path": [None] * len(k)})
        if last is not None:
            yield pd.DataFrame({"a": last[1], "b": last[1], "lcp": [-1], "home": last[2], "tree": last[0], "path": [last[3][0].tobytes()]})

    return run


def candidates(reps: DataFrame, trees: int, max_depth: int, least: int) -> DataFrame:
    """Parked (a, b, lcp, home) of neighbours in the sorted tries of reps(node, sig), lcp being the longest shared prefix of the pair, home the first value of a's signature."""
    parts = max(2, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = (reps.where("sig is not null")
            .select("node", "sig", F.conv(F.hex(F.substring("sig", 1, 4)), 16, 10).cast("long").alias("home"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
            .select("tree", F.substring("sig", F.col("tree") * (4 * max_depth) + 1, F.lit(4 * max_depth)).alias("path"), "node", "home"))
    shape = "a long, b long, lcp int, home long, tree int, path binary"
    near = park(rows.repartitionByRange(parts, "tree", "path", "node").sortWithinPartitions("tree", "path", "node").mapInPandas(_neighbours(least), shape))
    # the ends of the ranges, two a partition, meet each other as neighbours too
    ends = near.where("lcp = -1").select("tree", "path", F.col("a").alias("node"), "home").distinct().coalesce(1).sortWithinPartitions("tree", "path", "node")
    between = ends.mapInPandas(_neighbours(least), shape)
    return park(near.unionByName(between).where("lcp >= 0 and a <> b").groupBy("a", "b").agg(F.max("lcp").alias("lcp"), F.min("home").alias("home")))


def _equal_values(batches):
    for pdf in batches:
        if len(pdf):
            x, y = (np.frombuffer(b"".join(pdf[c]), ">u4").reshape(len(pdf), -1) for c in ("x", "y"))
            yield pd.DataFrame({"same": (x == y).sum(1), "lcp": pdf["lcp"]})


def classes_of(docs: DataFrame, threshold: float = 0.8, trees: int = 20, max_depth: int = 8, recall: float = 0.9999,
               block: int = 512, block_shingles: int = 150_000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, tag, comp (a number of the class, also where ids are repeated or null) and the columns of ngram_join(), a row for each of docs."""
    signed = park(signatures(docs, trees * max_depth))
    # the first row of a word sequence stands for it; ids may be shared by different texts, so sequences have numbers of their own
    place = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col("tag"))
    reps = park(signed.groupBy("digest").agg(F.min(place).alias("rep"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.max("size").alias("size"))
                .select("digest", F.monotonically_increasing_id().alias("node"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.tag").alias("rep_tag"), "n_copies", "sig", "size"))
    least = least_depth(trees, max_depth, threshold, recall)
    pairs = candidates(reps, trees, max_depth, least)
    known = reps.select("node", "sig")
    met = (pairs.join(known.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
           .select("x", "y", "lcp").mapInPandas(_equal_values, "same int, lcp int").groupBy("same", "lcp").agg(F.count("*").alias("n")).collect())
    depth = search_depth([tuple(r) for r in met], trees * max_depth, trees, least, max_depth, threshold, recall)
    label = components(contracted(pairs.where(F.col("lcp") >= depth), sum(n for _, lcp, n in met if lcp >= depth)))
    placed = label.join(reps.select(F.col("node").alias("id"), "rep_id", "rep_tag", "size"), "id")
    sizes = placed.groupBy("comp").agg(F.count("*").alias("m"), F.sum("size").alias("weight"))
    members = park(placed.join(sizes, "comp").withColumn("blocks", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("weight") / block_shingles)).cast("int"))
                   .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    n, weight = members.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, -(-n // 400), -(-weight // block_shingles))
    # a block meets itself and every other block of its component
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    slim = members.select("id", "comp", "block", "blocks", "rep_id", "rep_tag")
    texts = (docs.select("doc_id", "text").join(F.broadcast(slim) if n <= broadcast_rows else slim,
                                                F.col("doc_id").eqNullSafe(F.col("rep_id")) & (tag_of() == F.col("rep_tag")))
             .select("id", "comp", "block", "blocks", "text"))
    if not signed.groupBy("doc_id", "tag").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["id"])
    tasks = (texts.withColumn("meet", meets).select("id", "comp", "block", "blocks", "text", "meet.i", "meet.j")
             .withColumn("task", F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(parts))))
                         .otherwise(F.concat_ws("/", "comp", "i", "j"))))
    found = park(tasks.select("task", "id", "comp", "block", "i", "j", "text").groupBy("task")
                 .applyInPandas(_verify(threshold), "id long, n_links long, peer long, comp long"))
    links = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    # a text has a row for each block that its own meets: those of a component are contracted too
    classes = components(contracted(found.select(F.col("id").alias("a"), F.col("peer").alias("b"), F.col("comp").alias("home")), found.count()))
    first = (classes.join(reps.select(F.col("node").alias("id"), "rep_id"), "id").groupBy("comp").agg(F.min("rep_id").alias("class_id")))
    classes = classes.join(first, "comp").select(F.col("id").alias("node"), "comp", "class_id")
    table_of = (reps.select("digest", "node", "rep_id", "n_copies")
                .join(links.withColumnRenamed("id", "node"), "node", "left")
                .join(classes, "node", "left")
                .select("digest", "rep_id", "n_copies", F.coalesce("comp", "node").alias("comp"), F.coalesce("class_id", "rep_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    rows = signed.select("doc_id", "tag", "digest")
    many = max(1000, -(-rows.count() // HOT_DIGESTS))
    hot, rest = table_of.where(F.col("n_copies") >= many), table_of.where(F.col("n_copies") < many)
    names = reps.where(F.col("n_copies") >= many).select("digest")
    met = rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(names), "digest", "left_anti").join(rest, "digest"))
    return met.select("doc_id", "tag", "comp", "class_id", "rep_id", "n_copies", "n_links")


def ngram_join(docs: DataFrame, **params) -> DataFrame:
    """doc_id, class_id (smallest id of the class), rep_id (smallest id of equal word sequences), n_copies, n_links (to different texts); params as in classes_of()."""
    return classes_of(docs, **params).select("doc_id", "class_id", "rep_id", "n_copies", "n_links")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return ngram_join(table(spark, sf_dir, "documents"))
