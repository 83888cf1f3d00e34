"""Centroid clustering, ranked lexical search and secret scans against plain versions, and their defined results on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomrank.llm import centroids, lexical_search, secret_scan

BASE58 = secret_scan.BASE58


def brute_clusters(rows, clusters, rounds, dims):
    kept = [(i, [min(max(math.floor(256 * x), -centroids.LIMIT), centroids.LIMIT) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((r for r in kept), key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in enumerate(c))

    for _ in range(rounds):
        parts = [[] for _ in c]
        for _, v in kept:
            parts[near(v)[1]].append(v)
        c = [[sum(x) // len(p) for x in zip(*p, strict=True)] if p else w for p, w in zip(parts, c, strict=True)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=repr), c


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    middle = [[rng.uniform(-2, 2) for _ in range(4)] for _ in range(9)]
    rows = [(i, [rng.gauss(m, .3 if seed else .01) for m in rng.choice(middle)]) for i in range(900)]
    rows += [(1000 + i, [.5, .5, .5, .5]) for i in range(60)] + [(7, [0.0, 0.0, 0.0, 0.0])] * 5
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    found, c = centroids.centroid_clusters(d, clusters=12, rounds=5, dims=4)
    got = found.collect()
    want, means = brute_clusters(rows, 12, 5, 4)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == want and c == means
    # bounds spare most of the scans where clusters are apart
    assert sum(r["scans"] for r in got) < (.8 if seed else .7) * 6 * len(got)


def test_clusters_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [.1, .2]), (2, [.1, .2]), (None, [3.0, -3.0]), (3, None), (4, [1.0]), (5, [1.0, nan]), (6, [inf, 0.0]), (7, [None, 0.0]), (8, []), (9, [1e30, -1e30]),
            (10, [5e5, -5e5]), (1, [.3, .2]), (1, [.3, .2]), (None, [3.0, -3.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 2, 4, 40):
        found, c = centroids.centroid_clusters(d, clusters=k, rounds=4, dims=2)
        want, means = brute_clusters(rows, k, 4, 2)
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=repr) == want and c == means
    found, c = centroids.centroid_clusters(d.where("vec_id = 99"), dims=2)
    assert found.count() == 0 and c == []


def test_bounds_hold_under_drift():
    """However centroids move, the assignment is that of full scans, ties to the smaller number, also for components beyond exact doubles."""
    rng = np.random.default_rng(3)
    for size in (3, 300, centroids.EXACT * 8):
        v = rng.integers(-size, size, (500, 6))
        c = rng.integers(-size, size, (7, 6))
        c[3] = c[2]
        own, upper, lower, drift = np.full(500, -1), np.full(500, np.inf), np.zeros(500), np.zeros(7)
        for _ in range(8):
            own, upper, lower, _ = centroids.reassign(v, own, upper, lower, c, drift)
            exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
            assert own.tolist() == [d.index(min(d)) for d in exact]
            new = c + rng.integers(-max(1, size // 20), max(2, size // 20), c.shape)
            drift, c = np.nextafter(np.sqrt(((new - c) ** 2).sum(1).astype(float)), np.inf), new


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs, items, top):
    fold = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(i, fold(t)) for i, t in docs]
    n_docs, length = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    for item, text in items:
        scored = []
        for i, t in terms:
            tf = Counter(t)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * (75 + 25 * len(t) * n_docs // length))) for w in fold(text) if tf[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "ſ", "日本", "a1b2", "WORD", "word"]
    text = lambda k: "".join(rng.choice(words) + rng.choice(" \n.,-\x00\x7f@[") for _ in range(k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)] + [(200, None), (201, ""), (202, "..."), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, "w1 w2 w3"), (4, "w1 w2 w3"), (203, "w1 " * 30000)]
    items = [(i, text(rng.randint(1, 25))) for i in range(20)] + [(30, None), (31, "nowhere"), (32, "w1 w1 W1 w2"), (32, "w1 w1 W1 w2"), (None, "w3")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, score string, item int").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, list(dict.fromkeys(items)), 7)
    run = lambda: sorted(map(tuple, lexical_search.lexical_search(d, q, top=7).collect()), key=repr)
    assert run() == want
    # blocks of queries, sub-batches of documents and pieces of texts change nothing
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 20)
    monkeypatch.setattr(lexical_search, "TRIPLES", 5)
    assert run() == want


def test_search_empty_and_pieces(spark, monkeypatch):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.lexical_search(d, q).count() == 0 and lexical_search.lexical_search(q.toDF("doc_id", "text"), d.toDF("item_id", "text")).count() == 0
    monkeypatch.setattr(lexical_search, "PIECE", 3)
    assert [w for ws in lexical_search.pieces(b"abcdefgh i,jk  LM ") for w in ws] == [b"abcdefgh", b"i", b"jk", b"lm"]


def test_radix_order():
    rng = np.random.default_rng(1)
    for top in (1, 70000, 1 << 40, 1 << 63):
        keys = rng.integers(0, top, 5000, dtype=np.uint64)
        assert radix_sorted(keys) == sorted(keys.tolist())


def radix_sorted(keys):
    return keys[lexical_search.radix_order(keys)].tolist()


PLAIN = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24)}


def plain_secrets(text):
    return sorted(((k, m.start(), m.end()) for k, (e, fits) in PLAIN.items() for m in re.finditer(e, text or "") if fits(m)), key=lambda x: (x[1], list(PLAIN).index(x[0])))


def crc_token(prefix, body):
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        tail = secret_scan.BASE62[r] + tail
    return prefix + body + tail


def extended_key(byte):
    raw = bytes.fromhex("0488ade4") + bytes([byte]) * 74
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return out


#: A published example of the bech32 key format.
NSEC = "nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5"


def test_secrets_equal_plain_search(spark):
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "AKIA", "akia", "K", "ſecret", "\"", "'", " ", "  ", ":", "=", "abc123", "+/_.=-", "0123456789abcdef" * 2, "A1B2C3D4E5F6G7H8", "é", "İ", "日", "\U0001F600", "\n", "x"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "token=abcdef"), (None, "token=abcdef"), (902, "token" + " " * 50000 + "=" + "a" * 200000), (903, "password=token=secret=abc"), (904, "AKIA" * 9)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, secrets string").repartition(3)
    got = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["secrets"]], all(s["value"] for s in r["secrets"])) for r in secret_scan.secret_scan(d).collect()), key=repr)
    assert got == sorted(((i, plain_secrets(t), True) for i, t in rows), key=repr)
    assert secret_scan.secret_scan(d.where("doc_id = -1")).count() == 0


def test_secrets_with_checksums():
    good = {"github": crc_token("ghp_", "aB3" * 10), "npm": crc_token("npm_", "x9Z" * 10), "xprv": extended_key(7), "nsec": NSEC}
    for kind, token in good.items():
        text = f"é日 {token}, ok"
        assert (kind, 3, 3 + len(token)) in secret_scan.scan(text), kind
        other = token[:-1] + ("2" if token[-1] != "2" else "3")
        assert not [s for s in secret_scan.scan(f"see {other} end") if s[0] == kind]
        assert not [s for s in secret_scan.scan(f"see {token}Q end") if s[0] == kind]
        # base spans stay, at the same place before the method's own
        spans = secret_scan.scan(f"token={token}")
        assert [s[0] for s in spans] == ["assign", kind]
    assert not secret_scan.bech32_holds("AGE-SECRET-KEY-1" + "Q" * 58)


def test_secret_query(spark, sf_dir):
    import duckdb

    from loomrank.llm.queries import queries

    got = {r["doc_id"]: r for r in queries()["op13_secret_scan"](spark, sf_dir).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        spans, r = plain_secrets(text), got[i]
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in PLAIN)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(r["spans"].split(","))
