"""Operator 6: byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

A text is cut by the vocabulary's pattern; pieces that are tokens already take their rank. All other new
pieces of an Arrow batch become rows (piece, place, token), one per byte, and one recursive query per chunk
joins neighbouring rows to the merge table (left token, right token, merged token), finds each piece's
smallest merged rank and contracts its leftmost pair, until no pair is left. Ids are
decoded by an ordered aggregation over (document, position, token) rows joined to the vocabulary.

Pieces wider than two of the longest tokens are contracted in many places a round, where this can't change the result: see _WIDE.

Pieces already solved by a Python worker are kept in a bounded dictionary. Vocabulary and merge table are
fixed by the rank file (50,256 tokens), read by the driver and sent with the task, never read from
executors' disks. DuckDB has no folder to spill to.

Defined results: null text counts as empty; empty text has no ids (hash of the empty string); repeated rows get
equal answers; a null id stays null; very long texts are encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm.common import ids_of, small_batches, table, whole_ids

#: Solved pieces that a Python worker remembers, in two halves (about 200 bytes each): when the younger half is full, the older is dropped.
MAX_KNOWN = 240_000
#: Pieces that one recursive query solves at a time, and their bytes (unless a single one has more).
CHUNK, CHUNK_BYTES = 8_000, 1 << 17
_CODERS: dict = {}

#: run: a token's piece, place in the chunk, itself and the token after it. code orders a piece's pairs by rank, then place; best is the smallest of
#: the piece. Codes are unique in the chunk, so that one sort by place serves all pieces. A finished piece (no best) stands in one round only.
_NARROW = """
WITH RECURSIVE run AS (
  WITH ranked AS MATERIALIZED (
    SELECT b.place, b.piece, b.tok, b.ntok, (m.merged::BIGINT << 32) | b.place AS code FROM bytes b LEFT JOIN merges m ON m.pair = b.tok::BIGINT * 65536 + b.ntok WHERE NOT wide)
  SELECT ranked.*, best FROM ranked LEFT JOIN (SELECT piece, min(code) AS best FROM ranked WHERE code IS NOT NULL GROUP BY piece) USING (piece)
  UNION ALL
  (WITH ranked AS MATERIALIZED (
    SELECT x.*, (m.merged::BIGINT << 32) | x.place AS code
    FROM (
      SELECT place, piece, CASE WHEN code = best THEN best >> 32 ELSE tok END::INT AS tok,
             CASE WHEN code = best THEN after WHEN next_code = best THEN best >> 32 ELSE ntok END::INT AS ntok
      FROM (SELECT *, lag(code) OVER w AS before_code, lead(code) OVER w AS next_code, lead(ntok) OVER w AS after
            FROM run WHERE best IS NOT NULL WINDOW w AS (ORDER BY place))
      WHERE before_code IS DISTINCT FROM best) x
    LEFT JOIN merges m ON m.pair = x.tok::BIGINT * 65536 + x.ntok)
  SELECT ranked.*, best FROM ranked LEFT JOIN (SELECT piece, min(code) AS best FROM ranked WHERE code IS NOT NULL GROUP BY piece) USING (piece)))
SELECT piece, list(tok ORDER BY place) AS ids FROM run WHERE best IS NULL GROUP BY piece
"""


def _wide_query(rank_bits: int) -> str:
    """The recursive query for pieces wider than a cell. Cells are spans of two of the longest tokens; piece, cell and place rise together.

    A merge is due at the largest rank on the way to it: time = max(own rank, times of both tokens), since a pair that has a
    smaller rank than a token just made is merged at once. Pairs are therefore ordered by time, by the place of the token that set it,
    by rank, and by place (key). All that could take a token away from a pair before its turn begins within its own
    cell or the next to either side, so the smallest key of three cells is merged in any case, whatever else is (best).
    Equal pairs that follow each other (chains: aaaa) are merged two by two from the left, in one round, if nothing smaller stands in
    the cells around them and the new token has no earlier merge with what will stand beside it (mixing).
    Rows are kept by place: a token that has been merged into the one before it is -1.
    """
    at = 62 - 2 * rank_bits
    shift = at + rank_bits + 1
    due = "greatest(m.merged, x.time, x.ntime)"
    late = f"(m.merged < {due} AND x.ntime = {due})"

    def keyed(x: str) -> str:
        return f"""k AS MATERIALIZED (
    SELECT x.*, m.merged, CASE WHEN m.merged IS NOT NULL THEN ((({due}::BIGINT << {at}) | (x.place::BIGINT + CASE WHEN {late} THEN x.len ELSE 0 END)) << {rank_bits + 1})
      | (m.merged::BIGINT << 1) | (CASE WHEN {late} THEN 0 ELSE 1 END) END AS key
    FROM ({x}) x LEFT JOIN merges m ON m.pair = x.tok::BIGINT * 65536 + x.ntok),
  near AS (
    SELECT cell, min(low) OVER (ORDER BY cell RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS best, min(low) OVER (ORDER BY cell RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around
    FROM (SELECT cell, min(key) AS low FROM k GROUP BY cell))
  SELECT place, piece, k.cell, len, tok, time, ntok, ntime, merged, key, best, around FROM k JOIN near USING (cell)"""

    return f"""
WITH RECURSIVE run USING KEY (place) AS (
  WITH {keyed("SELECT place, piece, cell, 1 AS len, tok, 0 AS time, ntok, 0 AS ntime FROM bytes WHERE wide")}
 UNION ALL
  (WITH live AS MATERIALIZED (
    SELECT *, lag(tok) OVER w AS ptok, lead(ntok) OVER w AS nntok, lead(len) OVER w AS nlen
    FROM run WHERE tok >= 0 AND piece IN (SELECT piece FROM run WHERE best IS NOT NULL) WINDOW w AS (ORDER BY place)),
  ties AS (
    SELECT *, sum(CASE WHEN chained THEN 0 ELSE 1 END) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS chain
    FROM (SELECT place, piece, cell, place + len + nlen AS upto, merged, ptok, nntok, around >> {shift} = merged AS clear,
                 coalesce(lag(place + len) OVER w = place AND lag(merged) OVER w = merged, false) AS chained
          FROM live WHERE key >> {shift} = merged AND best >> {shift} = merged WINDOW w AS (ORDER BY place))),
  odds AS MATERIALIZED (
    SELECT *, row_number() OVER c % 2 = 1 AS odd, first_value(clear) OVER c AS sound FROM ties WINDOW c AS (PARTITION BY chain ORDER BY place)),
  mixing AS (
    SELECT cell FROM (SELECT *, CASE WHEN lag(upto) OVER (ORDER BY place) = place THEN merged ELSE ptok END AS before FROM odds WHERE odd) o
    LEFT JOIN merges a ON a.pair = o.before::BIGINT * 65536 + o.merged
    LEFT JOIN merges b ON b.pair = o.merged::BIGINT * 65536 + o.nntok
    LEFT JOIN merges c ON c.pair = o.merged::BIGINT * 65536 + o.merged
    WHERE least(a.merged, b.merged, c.merged) < o.merged),
  chosen AS (
    SELECT place FROM (
      SELECT place, odd, bool_and(sound AND cell NOT IN (SELECT unnest([cell - 1, cell, cell + 1]) FROM mixing)) OVER (PARTITION BY chain ORDER BY place) AS fine FROM odds)
    WHERE odd AND fine
    UNION SELECT place FROM live WHERE key = best),
  taken AS (
    SELECT *, coalesce(lag(take) OVER (ORDER BY place), false) AS eaten
    FROM (SELECT live.*, c.place IS NOT NULL AS take FROM live LEFT JOIN chosen c USING (place))),
  now AS (
    SELECT place, piece, cell, CASE WHEN take THEN len + nlen ELSE len END AS len, CASE WHEN eaten THEN -1 WHEN take THEN merged ELSE tok END AS tok,
           CASE WHEN take THEN greatest(merged, time, ntime) ELSE time END AS time, eaten FROM taken),
  paired AS (
    SELECT place, piece, cell, len, tok, time, CASE WHEN NOT eaten AND lead(piece) OVER w = piece THEN lead(tok) OVER w END AS ntok, lead(time) OVER w AS ntime
    FROM now WINDOW w AS (PARTITION BY eaten ORDER BY place)),
  {keyed("SELECT * FROM paired")})
)
SELECT piece, list(tok ORDER BY place) AS ids FROM run WHERE tok >= 0 GROUP BY piece
"""


#: The connection has one thread, which keeps the order of the sorted rows for the aggregation.
_DECODE = "SELECT doc, string_agg(chars, '') AS chars FROM (SELECT doc, chars FROM encoded JOIN vocabulary USING (id) ORDER BY pos) GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(pair, merged) columns: every way to make a token of two tokens, the pair written as left * 65536 + right."""
    pairs, merged = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs.append(left * 65536 + right)
                merged.append(rank)
    return pairs, merged


def _chunks(pieces: list[str]):
    """Groups of at most CHUNK pieces and about CHUNK_BYTES; alike lengths together, so that long ones don't keep short ones waiting."""
    group, held = [], 0
    for p in sorted(pieces, key=len):
        if group and (len(group) >= CHUNK or held + len(p) > CHUNK_BYTES):
            yield group
            group, held = [], 0
        group.append(p)
        held += len(p)
    if group:
        yield group


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*parts, np.empty(0)]).astype(np.int32))


class Coder:
    """Encodes and decodes in one DuckDB connection; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb

        self.ranks, self.cut, self.young, self.old = ranks, regex.compile(pattern), {}, {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        pairs, merged = merge_table(ranks)
        self.db.register("m", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())}))
        # a byte stands as the character of its number, so that strings can be aggregated
        self.db.register("v", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "chars": [t.decode("latin-1") for t in ranks]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v ORDER BY id")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cell = 2 * max(map(len, ranks))
        self.wide = _wide_query(max(1, max(ranks.values()).bit_length()))

    def solve(self, pieces: list[str]) -> None:
        """Ids of pieces that aren't tokens, into self.young."""
        raw = [p.encode("utf-8") for p in pieces]
        n = np.array([len(p) for p in raw])
        tok = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        ends, place = np.cumsum(n), np.arange(len(tok), dtype=np.int32)
        last = np.zeros(len(tok), bool)
        last[ends - 1] = True
        cells = -(-n // self.cell)
        # two cells stay empty between pieces, so that none sees its neighbours
        first = np.cumsum(cells + 2) - cells - 2
        self.db.register("bytes", pa.table({
            "piece": np.repeat(np.arange(len(n), dtype=np.int32), n), "place": place, "tok": tok,
            "ntok": pa.array(np.append(tok[1:], np.int32(0)), mask=last), "wide": np.repeat(cells > 1, n),
            "cell": (np.repeat(first, n) + (place - np.repeat(ends - n, n)) // self.cell).astype(np.int32)}))
        for query, needed in ((_NARROW, (cells == 1).any()), (self.wide, (cells > 1).any())):
            if needed:
                found = self.db.sql(query).to_arrow_table()
                ids = found["ids"].combine_chunks()
                flat, bounds = ids.values.to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy() * 4
                for k, start, end in zip(found["piece"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    self.young[pieces[k]] = flat[start:end]
        self.db.unregister("bytes")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut.findall(t) for t in texts]
        if len(self.young) > MAX_KNOWN // 2:
            self.young, self.old = {}, self.young
        known, hard = self.young, []
        for p in set().union(*cut).difference(known):
            rank = self.ranks.get(p.encode("utf-8"))
            if rank is not None:
                known[p] = rank.to_bytes(4, "little")
            elif p in self.old:
                known[p] = self.old[p]
            else:
                hard.append(p)
        for chunk in _chunks(hard):
            self.solve(chunk)
        return [np.frombuffer(b"".join(map(known.__getitem__, c)), "<u4") for c in cut]

    def decode(self, encoded: list[np.ndarray]) -> list[bytes]:
        n = np.array([len(e) for e in encoded], np.int64)
        ids = np.concatenate([*encoded, np.empty(0)]).astype(np.int32)
        self.db.register("encoded", pa.table({"doc": np.repeat(np.arange(len(n)), n), "pos": np.arange(len(ids)), "id": ids}))
        found = dict(self.db.sql(_DECODE).fetchall())
        self.db.unregister("encoded")
        return [found.get(k, "").encode("latin-1") for k in range(len(encoded))]


def coder(ranks: dict[bytes, int], pattern: str) -> Coder:
    """The worker process's coder for this vocabulary: Spark reuses its Python workers from task to task."""
    key = hash((pattern, len(ranks), hash(frozenset(ranks.items()))))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(ranks, pattern)
    return _CODERS[key]


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary) for docs(doc_id, text)."""
    def run(batches):
        own = coder(ranks, pattern)
        for pdf in batches:
            ids = own.encode(pdf["text"].fillna("").tolist())
            yield pd.DataFrame({"doc_id": ids_of(pdf), "ids": [i.astype(np.int32) for i in ids], "decoded": own.decode(ids)})

    small_batches(docs.sparkSession)
    return whole_ids(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """encode_decode() summed up: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    def run(batches):
        own = coder(ranks, pattern)
        for pdf in batches:
            ids = own.encode(pdf["text"].fillna("").tolist())
            lists = _lists(ids)
            written = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, lists.values.cast(pa.string())), ",")
            yield pd.DataFrame({"doc_id": ids_of(pdf), "n_tokens": [len(i) for i in ids],
                                "ids_sha256": [hashlib.sha256(w.as_buffer()).hexdigest() for w in written],
                                "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in own.decode(ids)]})

    small_batches(docs.sparkSession)
    return whole_ids(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
