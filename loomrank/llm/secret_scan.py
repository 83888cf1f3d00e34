"""Operator 13: secret scans by an Aho-Corasick prefilter, anchored expressions and checksums.

One automaton over all keywords runs through each whole text; only where it hits is the expression of that keyword tried, anchored at the
hit, so the cost of a text is one pass and a few short matches. As every match of an expression begins with its keyword, trying the hits in order and
skipping those inside the last match gives the leftmost non-overlapping matches, those of a search through the whole text. Runs of hex digits
have no keyword of their own: the text is mapped to character classes and the keyword is 24 letters of the class.

Base kinds are `assign`, `access` and `hex`. The checksummed kinds count only if the checksum inside the token holds, so that
look-alikes are left alone: `github` and `npm` tokens (CRC-32 in base 62), `xprv` extended private keys (double SHA-256 in base 58),
`age` and `nsec` keys (bech32). They add spans and never remove one.

Defined results: null counts as empty and has no spans; offsets are code points, whatever the text's encoding; repeated rows get equal
answers; a null id stays null; very long texts are scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm.common import small_batches, table

BASE = ("assign", "access", "hex")
#: Order of kinds at one place.
KINDS = (*BASE, "github", "npm", "xprv", "age", "nsec")

#: The alphabets of the checksummed formats.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_holds(token: str) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    body, want, rest = token[-36:-6], token[-6:], zlib.crc32(token[-36:-6].encode())
    got = ""
    for _ in want:
        rest, digit = divmod(rest, 62)
        got = BASE62[digit] + got
    return len(body) == 30 and got == want


def base58_holds(token: str) -> bool:
    """The last four of 82 bytes are the start of the double SHA-256 of the others."""
    number = 0
    for c in token:
        number = number * 58 + BASE58.index(c)
    if number >= 1 << 656:
        return False
    raw = number.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_holds(token: str) -> bool:
    prefix, _, data = token.lower().rpartition("1")
    state = 1
    for value in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ value
        for i, step in enumerate(BECH32_STEPS):
            state ^= step * (top >> i & 1)
    return state == 1


def _whole(check: Callable[[str], bool]) -> Callable[[str, re.Match], bool]:
    """The token stands free of other letters and digits, and its checksum holds."""
    def test(text: str, m: re.Match) -> bool:
        before, after = text[m.start() - 1:m.start()], text[m.end():m.end() + 1]
        return not (before.isalnum() or after.isalnum() or after == "_") and check(m[0])

    return test


#: kind: its keywords in lower case, the expression that begins with one of them, and what else a match must fulfil.
RULES: dict[str, tuple[tuple[str, ...], str, Callable[[str, re.Match], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "api_key", "apikey"),
               r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda text, m: m.end(1) - m.start(1) >= 6),
    "access": (("akia",), r"AKIA[A-Z0-9]+", lambda text, m: m.end() - m.start() >= 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}", _whole(crc_holds)),
    "npm": (("npm_",), r"npm_[A-Za-z0-9]{36}", _whole(crc_holds)),
    "xprv": (("xprv",), r"xprv[1-9A-HJ-NP-Za-km-z]{107}", _whole(base58_holds)),
    "age": (("age-secret-key-1",), r"AGE-SECRET-KEY-1[AC-HJ-NP-Z02-9]{58}", _whole(bech32_holds)),
    "nsec": (("nsec1",), r"nsec1[ac-hj-np-z02-9]{58}", _whole(bech32_holds)),
}
SHORTEST_HEX = 24
_HEX = re.compile("[0-9a-f]+")
_CLASSES = bytes(ord("h") if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_READY: dict = {}


def _automaton():
    """The automaton over all keywords and the compiled expressions, built once in each Python worker."""
    if not _READY:
        keys: dict[str, list[str]] = {}
        for kind, (words, _, _) in RULES.items():
            for w in words:
                keys.setdefault(w, []).append(kind)
        machine = ahocorasick.Automaton()
        for w, kinds in keys.items():
            machine.add_word(w, (len(w), kinds))
        machine.make_automaton()
        _READY.update(machine=machine, rules={k: (re.compile(e), test) for k, (_, e, test) in RULES.items()})
    return _READY["machine"], _READY["rules"]


def hex_spans(text: str) -> list[tuple[int, int]]:
    """Maximal runs of at least 24 hex digits, [0-9a-f]."""
    # one byte a code point: what isn't Latin-1 becomes a question mark, which is no hex digit
    classes, keyword, out = text.encode("latin-1", "replace").translate(_CLASSES), b"h" * SHORTEST_HEX, []
    at = classes.find(keyword)
    while at >= 0:
        end = _HEX.match(text, at).end()
        out.append((at, end))
        at = classes.find(keyword, end)
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start and kind."""
    if not text:
        return []
    machine, rules = _automaton()
    # ASCII letters alone are lowered, so that no place moves
    folded = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found, free = [("hex", *span) for span in hex_spans(text)], dict.fromkeys(RULES, 0)
    hits = sorted((end + 1 - size, kind) for end, (size, kinds) in machine.iter(folded) for kind in kinds)
    for start, kind in hits:
        if start >= free[kind] and (m := rules[kind][0].match(text, start)):
            free[kind] = m.end()
            if rules[kind][1](text, m):
                found.append((kind, start, m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def _scan_batches(batches):
    for b in batches:
        texts = b.column("text").to_pylist()
        spans = [[{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in scan(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "secrets"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, secrets (kind, start, end, value) for each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, "doc_id long, secrets array<struct<kind string, start int, end int, value string>>")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    found, all_ = secret_scan(table(spark, sf_dir, "documents")), F.col("secrets")
    of = lambda *kinds: F.filter(all_, lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(all_).alias("spans"))
