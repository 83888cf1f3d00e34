"""Each training-data operator against SQL or a plain version, and its defined results on odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrank.llm import (
    byte_bpe, common, exact_dedup, language_id, line_dedup, lyndon, mixing, ngram_join, quality_rules, queries, suffix_dedup, toxicity, url_filter)

from ..oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, `key` int, keep_id string"
LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and blank texts, repeated rows, ties, one very long text, columns with clashing names."""
    base = "The quick brown fox jumps over the lazy dog and then goes home to sleep until the morning comes"
    texts = [None, "", " \n\t ", base, base, base + " again", LONG, "é ü ñ 日本語 \U0001F600", "a", "line\nline\n\nline", base.upper(), "\x00\x01 control"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "x", 1, "y") for i, t in enumerate(texts)]
    rows += [rows[3], rows[0], (None, base, "en", "s1", 1, "x", 1, "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], sf_dir)


def test_exact_dedup_odd(odd, empty):
    got = exact_dedup.exact_dedup(odd.where("doc_id is not null"), salts=3).collect()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["keep_id"], r["group_size"], r["kept"]))
    assert by[3] == {(4, 3, False)} and by[4] == {(4, 3, True)} and by[0] == {(1, 3, False)} and by[1] == {(1, 3, True)}
    assert len(got) == 14 and exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_many_batches(spark):
    rows = [(i, "same" if i % 3 else f"own {i}", "x") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, z string").repartition(8)).collect()
    assert all((r["keep_id"], r["group_size"]) == ((2999, 2000) if r["doc_id"] % 3 else (r["doc_id"], 1)) for r in got)


def test_exact_dedup_null_ids(spark, odd):
    big = 2**53
    rows = [(None, "a"), (big + 1, "a"), (big, "a"), (None, "a"), (None, "b"), (None, "c"), (7, "d"), (None, "d"), (None, None), (None, "")] + [(None, "b")] * 9
    for d in (odd, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)):
        groups = defaultdict(list)
        for r in d.collect():
            groups[r["text"] or ""].append(r["doc_id"])
        want = []
        for text, ids in groups.items():
            top = max((i for i in ids if i is not None), default=None)
            want += [(i, top, len(ids), None if i is None else i == top, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
        assert sorted(map(repr, map(tuple, exact_dedup.exact_dedup(d, salts=3).collect()))) == sorted(map(repr, want))


def brute_suffix(rows, width):
    seen, out = {}, {}
    for i in sorted({r[0] for r in rows}):
        mine = set()
        for d, t in rows:
            if d != i:
                continue
            raw = (t or "").encode()
            gone = bytearray(len(raw))
            for p in range(len(raw) - width + 1):
                w = raw[p:p + width]
                mine.add(w)
                if w in seen:
                    gone[p:p + width] = b"\1" * width
            kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
            out.setdefault(i, []).append((len(raw), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
        seen.update(dict.fromkeys(mine, i))
    return {k: sorted(v) for k, v in out.items()}


def check_suffix(spark, rows, **k):
    d = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, runs string")
    got = defaultdict(list)
    for r in suffix_dedup.suffix_dedup(d, digest=True, **k).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert {i: sorted(v) for i, v in got.items()} == brute_suffix(rows, k.get("width", 50))


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abc é") for _ in range(rng.randint(20, 160))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 30):] for _ in range(rng.randint(0, 6)))) for i in range(60)]
    check_suffix(spark, rows)


def test_suffix_dedup_odd(spark):
    line = "this very same passage of more than fifty bytes stands in many documents"
    rows = [(0, None), (1, ""), (2, "a" * 300), (3, "a" * 120), (4, "ab" * 100), (5, line), (5, "other " + line), (6, line[:50]), (7, line[:49]), (8, "\x00" * 80), (9, "\x00" * 60)]
    rows += [(10 + i, f"{i:040d}" + line + f"{i * 7919:060d}") for i in range(150)]
    check_suffix(spark, rows, docs_per_bucket=40)


@pytest.mark.parametrize("top", [7, 2**53 + 1, 2**63 - 1])
def test_suffix_dedup_null_ids(spark, odd, top):
    line = "this very same passage of more than fifty bytes stands in many documents"
    rows = [(None, "start " + line), (top, line), (top - 1, line + " end"), (None, line * 2), (None, "only rows without an id have this passage, and it is long enough"),
            (None, "only rows without an id have this passage, and it is long enough"), (None, None)]
    for own in (rows, [(r["doc_id"], r["text"]) for r in odd.collect()]):
        # ranks stand for ids in the plain version, null's being the largest
        ids = sorted({i for i, _ in own if i is not None}) + [None]
        want = {ids[k]: v for k, v in brute_suffix([(ids.index(i), t) for i, t in own], 50).items()}
        got = defaultdict(list)
        for r in suffix_dedup.suffix_dedup(spark.createDataFrame(own, "doc_id long, text string").coalesce(1), digest=True).collect():
            got[r["doc_id"]].append(tuple(r)[1:])
        assert {i: sorted(v) for i, v in got.items()} == want


def test_suffix_dedup_tiles(spark, monkeypatch):
    rng = random.Random(8)
    a = "".join(rng.choice("abcdefgh ") for _ in range(suffix_dedup.TILE + 5000))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame([(0, a), (1, "x" + a[suffix_dedup.TILE - 500:suffix_dedup.TILE + 500])], "doc_id long, text string"), digest=True).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {0: 0, 1: 1000}


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_lyndon_suffix_arrays():
    rng = random.Random(1)
    for _ in range(100):
        strings = [[rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 40))] + [0] for _ in range(rng.randint(1, 9))]
        n = np.array([len(s) for s in strings])
        base = np.cumsum(n) - n
        sa = lyndon.suffix_arrays(np.array([c for s in strings for c in s]), base, n)
        for s, b, m in zip(strings, base, n, strict=True):
            assert (sa[b:b + m] - b).tolist() == sorted(range(m), key=lambda i, s=s: s[i:])


def brute_join(rows, threshold=.8):
    groups = defaultdict(list)
    for i, text in rows:
        groups[tuple(ngram_join.word_list(text))].append(i)
    sets = {min(v): {w[k:k + 5] for k in range(max(1, len(w) - 4))} if w else set() for w, v in groups.items()}
    root, links = {i: i for i in sets}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            common_ = len(sets[a] & sets[b])
            if common_ and common_ >= threshold * (len(sets[a]) + len(sets[b]) - common_) - 1e-9:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (find(min(v)), min(v), len(v), links[min(v)]) for v in groups.values() for i in v}


def test_ngram_join_equals_brute_force(spark):
    rng, words = random.Random(6), [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "edit"
            rows.append((len(rows), " ".join(own)))
    rows += [(900 + i, t) for i, t in enumerate([None, "", " \n", "one", "one", "one two", LONG, LONG + " end"])]
    d = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, block int, comp string")
    want = brute_join(rows)
    for block in (512, 6):  # 6: components in several blocks
        got = {r["doc_id"]: (r["class_id"], r["rep_id"], r["n_copies"], r["n_links"]) for r in ngram_join.ngram_join(d, block=block).collect()}
        assert got == want


def test_ngram_join_depth_and_empty(empty):
    least = ngram_join.least_depth(20, 8, .8, .9999)
    assert ngram_join.expected_recall(least, 20, .8) >= .9999 > ngram_join.expected_recall(least + 1, 20, .8)
    near, far = [(158, 8, 100)], [(158, 8, 100), (130, 8, 3), (130, 5, 2)]
    assert ngram_join.search_depth(near, 160, 20, least, 8, .8, .9999) == 8
    assert ngram_join.search_depth(far, 160, 20, least, 8, .8, .9999) == least
    assert ngram_join.search_depth(far, 160, 20, least, 8, .8, .97) > least
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_recall_near_the_threshold(spark):
    """Pairs at 0.80 to 0.90 and nothing closer: at least nine in ten of the links are found (all of them, as a rule)."""
    rng, rows = random.Random(3), []
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(rng.randint(60, 120))]
        own = list(base)
        own[rng.randrange(5, len(own) - 5)] = "edit"
        if rng.random() < .5:
            own = own[rng.randint(1, 3):]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
    want = brute_join(rows)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = sum(v[3] for v in want.values())
    assert wanted > 150 and sum(got.values()) >= .99 * wanted and all(got[i] <= want[i][3] for i in got)


def test_quality_rules_odd(odd, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert len(got) == 13 and got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[0]["kept"]
    assert got[6]["n_words"] == 40000 and got[6]["n_repeat_words"] == 40000 and got[6]["base_failed"]
    assert got[9]["n_dup_lines"] == 2
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_order_changes_no_verdict(odd):
    judged = quality_rules.rules()
    order = quality_rules.measured_order(quality_rules.features(odd), judged)
    assert sorted(order) == sorted(judged)


def test_line_dedup_odd(spark, odd, empty):
    assert line_dedup.line_dedup(odd).count() == 15 and line_dedup.line_dedup(empty).count() == 0
    rows = [(i, "h", f"own {i}\nshared\n\n tail {i % 9}") for i in range(40)] + [(99, None, None), (98, None, "shared")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_lines", F.lit("clash"))
    want = {i: f"own {i}\n\n tail {i % 9}" if 40 - i else "" for i in range(40)}
    for limit in (line_dedup.BROADCAST_ROWS, 0):
        got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(d, ratio=.5, broadcast_rows=limit).collect()}
        assert {i: got[i] for i in want} == want and got[99] is None and got[98] == "shared"


def test_mixing_odd(odd, empty):
    assert mixing.mix(empty).count() == 0 and mixing.shares(empty).count() == 0
    got = mixing.mix(odd.drop("size")).collect()
    assert len(got) == 15 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd.drop("size"), broadcast_rows=0).collect()))


def test_mixing_equal_rows(spark):
    """40 equal rows on the edge: as many are taken as bring the total nearest to the target."""
    rows = [(7, "a", "w " * 100)] * 40 + [(None, "b", "w " * 50)] * 30 + [(1, "c", "w " * 10)]
    d = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, source string, text string, extra string, target int").repartition(5)
    for got in (mixing.shares(d).collect(), mixing.mix(d).collect()):
        assert len(got) == len(rows) and {r["taken"] % r["size"] for r in got} == {0}
        for source in "abc":
            own = [r for r in got if r["source"] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= own[0]["size"] / 2
            assert max(r["epochs"] for r in own) - min(r["epochs"] for r in own) <= 1


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1), ("c", 1), (None, 88)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["b"] == 3 and got["c"] == 3 and got["a"] == 30 and got[None] == 64
    assert sum(got.values()) == 100


def test_toxicity_swaps_and_odd(spark, odd):
    bad, good = ["you are a moron", "total scum and moron", "what a moron you scum"], ["nice day at the sea", "we walked home", "good soup"]
    rows = [(i, (bad[i % 3] + (" the muslims" if i % 4 else "")) if i % 2 else good[i % 3], i % 2) for i in range(400)]
    weights, b = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    logit = lambda s: b + sum(weights.get(w, 0) for w in toxicity.marks(toxicity.words(s)))
    assert logit("moron scum") > 1 > -1 > logit("nice soup at home")
    plain, _ = toxicity.fit([([0, 1], 1), ([0], 1), ([2], 0)] * 50, [], 4)
    swapped, _ = toxicity.fit([([0, 1], 1), ([0], 1), ([2], 0)] * 50, [([1], [3], 50)], 4)
    assert abs(swapped[1] - swapped[3]) < .2 * abs(plain[1] - plain[3])
    assert toxicity.score(odd, weights, b).count() == 15
    none = toxicity.toxicity(odd, odd.select("doc_id", "text", F.lit(None).cast("int").alias("toxic")))
    assert none.agg(F.max("score")).first()[0] < 1e-6


def test_toxicity_held_out(spark, sf_dir):
    got = queries.queries()["op2_toxicity"](spark, sf_dir.replace("sf0.001", "sf0.01")).join(common.table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels"), "doc_id").where("held_out").collect()
    hit = [r for r in got if r["toxic"]]
    assert sum(r["predicted"] for r in hit) >= .7 * len(hit)
    assert sum(r["predicted"] for r in got if not r["toxic"]) <= .05 * len(got)


def test_language_held_out_and_odd(spark, sf_dir, odd, empty):
    got = queries.queries()["op5_language_id"](spark, sf_dir).join(common.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= .9 * len(got)
    content = language_id.dictionaries(odd.select("doc_id", "text", "lang"))
    by = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, content).collect()}
    assert by[0] == by[1] == by[2] == "und" and by[8] == "en"
    assert language_id.predict(empty, {}).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe.public_vocabulary()


def test_bpe_equals_library(tokenizer):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = tokenizer
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", "Hello world's  end\n\n", "a" * 5000, "ab" * 700, "日本語" * 40, "\U0001F600" * 20, "!" * 333, " " * 500 + "x", "\x00\x01", "<|endoftext|>"]
    texts += ["".join(rng.choice("etaoin shrdlu éß.,!?\n1") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(60)) for _ in range(40)]
    own = byte_bpe.Coder(ranks, pattern)
    ids = own.encode(texts)
    assert [i.tolist() for i in ids] == [enc.encode_ordinary(t) for t in texts]
    assert own.decode(ids) == [t.encode() for t in texts]


def test_bpe_wide_pieces(tokenizer):
    """Pieces of many cells, with chains, periods and pairs of smaller rank than their parts, come out as one pair at a time would make them."""
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = tokenizer
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own, rng = byte_bpe.Coder(ranks, pattern), random.Random(5)
    kinds = ["ab", "abn", "abc", "the", "aeiouhtns", "abcdefghijklmnopqrstuvwxyz", "éàü", "дежа", "日本語", "=-_.", "01"]
    pieces = ["".join(rng.choice(rng.choice(kinds[:6])) for _ in range(rng.randint(0, 3))) + k * rng.randint(40, 120) for k in kinds]
    pieces += ["".join(rng.choice(k) for _ in range(rng.randint(67, 400))) for k in kinds for _ in range(12)] + ["q" * 30_000, "aab" * 9_000]
    pieces = sorted({p for p in pieces if len(p.encode()) > own.cell})
    own.solve(pieces)
    assert {p: np.frombuffer(own.young[p], "<u4").tolist() for p in pieces} == {p: enc._encode_single_piece(p.encode()) for p in pieces}


def test_bpe_odd(odd, empty, tokenizer):
    got = byte_bpe.encode_decode(odd, *tokenizer).collect()
    want = sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in odd.collect())
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in got) == want
    assert byte_bpe.digests(empty, *tokenizer).count() == 0


def test_url_rules_and_trees(spark):
    urls = [None, "", "no scheme", "http://a.net/x", "https://Blog.Example.NET/en/1?x", "http://example.com/de/1", "http://example.com/de", "https://x.org/fr/", "https://org/fr/q#z", "http://notexample.net/en/", "http://x.com/a"]
    urls += [f"http://h{i}.net/{'9' * (i % 5)}" for i in range(40)] + [f"http://h{i}.org/fr/abc" for i in range(40)]
    d = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string").drop("rule").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge(d).collect()}
    assert [got[i]["rule"] for i in range(11)] == [None, None, None, "net/", "example.net/en/", "example.com/de/", None, "org/fr/", "org/fr/", "net/", None]
    assert got[4]["host"] == "blog.example.net" and got[4]["path"] == "/en/1" and got[4]["verdict"] == "allow"
    assert got[0]["host"] == got[2]["path"] == "" and {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(d.limit(0)).count() == 0


def test_url_entropy_of_whole_text(spark):
    texts = ["", "a", "aab", "abcd" * 3000 + "e", "\U0001F600é\U0001F600"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(url_filter._entropy(F.col("t"))).collect()]
    want = [sum(-n / len(t) * np.log2(n / len(t)) for n in Counter(t).values()) for t in texts]
    assert np.allclose(got, want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["comp"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_components_join_little_more_than_their_vertices(spark, monkeypatch):
    """A forest, as contracted links are, and a chain of mixed ids: joined rows stay near the number of vertices, whatever the number of rounds."""
    n = 1000
    mixed = [(i * 719) % n for i in range(n)]
    for edges, limit in ([(i, (i - 1) // 8) for i in range(1, n)], 100_000), (list(zip(mixed, mixed[1:], strict=False)), 10):
        rows = []
        written = common.park
        monkeypatch.setattr(common, "park", lambda df, rows=rows: rows.append(p := written(df)) or p)
        got = common.components(spark.createDataFrame(edges, "a long, b long"), broadcast_rows=limit).collect()
        assert {r["comp"] for r in got} == {0} and len(got) == n
        # rows that have met labels
        assert 0 < sum(p.count() for p in rows if "was" in p.columns) <= 10 * n
        monkeypatch.setattr(common, "park", written)
