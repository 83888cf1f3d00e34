"""The pipeline against a plain version, stage by stage."""

import hashlib

import duckdb
import pytest

import corpus_pipeline as p
from loomrank.llm import byte_bpe, common, line_dedup, mixing, quality_rules

from .test_operators import brute_join, odd  # noqa: F401


def test_run_equals_plain_version(spark, sf_dir):
    tiktoken = pytest.importorskip("tiktoken")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cols = ", ".join(p.DOC_COLUMNS)
    con.execute(f"CREATE TABLE good AS SELECT {cols} FROM ({quality_rules.features_sql('documents')}) WHERE kept")
    con.execute(f"CREATE TABLE clean AS SELECT doc_id, cleaned AS text, lang, source, n_chars FROM ({line_dedup.clean_sql('good')})")
    rows = con.execute("SELECT doc_id, text FROM clean").fetchall()
    stay = [i for i, v in brute_join(rows).items() if v[0] == i]
    con.execute("CREATE TABLE once AS SELECT * FROM clean WHERE doc_id IN (SELECT unnest(?))", [stay])
    taken = con.execute(f"SELECT doc_id, text, epochs FROM ({mixing.mix_sql('once')})").fetchall()
    ranks, pattern = byte_bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text, n in taken:
        ids = enc.encode_ordinary(text)
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * n
    assert sorted(tuple(r) for r in p.run(spark, sf_dir).collect()) == sorted(want)


def test_stages_of_empty_and_odd_tables(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_near_duplicates_keep_one_row_of_a_class(spark, odd, sf_dir):  # noqa: F811
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (None, c), (None, a + " tail"), (None, "alone"), (None, "alone"), (9, "x y"), (9, "x  y")]
    d = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, d, sf_dir).collect()), key=repr)
    assert [g for g in got if g[0] != 9] == sorted([(3, b), (5, a), (7, c), (None, "alone")], key=repr)
    assert len([g for g in got if g[0] == 9]) == 1
    # base (3, 4, 3 and null) and its longer version, blanks (0, 1, 2 and 0), and the rest each once
    kept = [r["doc_id"] for r in p.near_duplicates(spark, odd, sf_dir).collect()]
    want = {v[0] for v in brute_join([(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()]).values()}
    assert sorted(kept) == sorted(want)


def test_stages_of_odd_table(spark, odd, sf_dir):  # noqa: F811
    docs, n = odd.select(*common.DOC_COLUMNS), odd.count()
    want = {"line_dedup": n, "byte_bpe": n}
    for name, stage in p.STAGES:
        got = stage(spark, docs, sf_dir)
        assert name not in want or got.count() == want[name]
        assert name == "byte_bpe" or got.columns == list(common.DOC_COLUMNS)
        got.collect()
