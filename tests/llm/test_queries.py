"""The corpus queries against oracles, libraries and plain versions on the smallest tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel import llm
from tidewheel.llm import bagminhash, bpe, decontaminate, language, perspectives, quality, rans, rollup, secrets
from tidewheel.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


def plain(rows):
    return sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("key", sorted(llm.oracle_sql()))
def test_oracle(spark, key):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = llm.queries()[key](spark, SF)
    columns = sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(con.sql(f"SELECT {', '.join(columns)} FROM ({llm.oracle_sql()[key]})").fetchall())


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    for r in bpe.op5_bpe_backtrack(spark, SF).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rans_files_hold_the_library_s_ids(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(rans.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    start = 0
    for r in sorted(rans.op9_rans_tokens(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, rans.END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    found = [r for r in language.op2_language_spans(spark, SF).collect() if r.held_out and truth[r.doc_id]]
    assert len(found) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in found) >= 0.9 * len(found)


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secrets_keep_all_base_spans(spark, texts):
    for r in secrets.op7_secret_scan(spark, SF).collect():
        text = texts[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [sum(k == n for _, k, _ in base) for n in range(3)] == [r.n_assign, r.n_access, r.n_hex]
        assert set(filter(None, joined.split(","))) <= set(filter(None, (r.spans or "").split(",")))


def test_pipeline_decisions(spark):
    """Each stage against what its operator says of the stage's own input."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), "test")
        assert out.columns == columns
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        if stage is corpus_pipeline.near_duplicates:
            assert after == {r.doc_id for r in bagminhash.classes(docs).filter("first").collect()}
        if stage is corpus_pipeline.secret_scan:
            assert after == before
        docs = out
    assert {r.doc_id for r in corpus_pipeline.bpe_encode(spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("key", ["op1_perspectives", "op2_language_spans", "op3_decontaminate", "op4_kneser_ney", "op5_bpe_backtrack", "op6_bagminhash", "op7_secret_scan", "op8_adaptive_quality", "op9_rans_tokens", "op10_token_rollup", "op11_prefix_trie", "op12_threshold_search", "op13_simhash"])
def test_odd_tables(spark, tmp_path, key):
    """Nulls in every column, empty texts, repeated rows, extra columns that clash; then empty tables."""
    text = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "").otherwise(F.col("text"))
    docs = table(spark, SF, "documents").limit(60)
    null = lambda c, n: F.when(F.col("doc_id") % n == 0, None).otherwise(F.col(c)).alias(c)
    odd = docs.select("doc_id", text.alias("text"), null("lang", 7), null("source", 6), null("n_chars", 3), F.lit("k").alias("key"), F.lit(1).alias("node"), F.lit("t").alias("t"))
    turns = table(spark, SF, "conversations").limit(80)
    turns = turns.withColumn("role", F.when(F.col("turn") == 1, None).otherwise(F.col("role"))).withColumn("text", F.when(F.col("turn") == 2, None).otherwise(F.col("text"))).withColumn("speaker", F.lit("x"))
    bench = table(spark, SF, "benchmark").withColumn("text", F.when(F.col("item_id") % 4 == 0, None).otherwise(F.col("text")))
    for name, rows in (("odd", None), ("empty", 0)):
        folder = f"{tmp_path}/{name}"
        for t, df in (("documents", odd.union(odd.limit(3))), ("conversations", turns), ("benchmark", bench), ("labels", table(spark, SF, "labels"))):
            (df if rows is None else df.limit(0)).write.parquet(f"{folder}/{t}.parquet")
        out = llm.queries()[key](spark, folder)
        n = out.count()
        assert n == 0 or rows is None
        if rows is None and key not in ("op1_perspectives", "op10_token_rollup", "op11_prefix_trie", "op12_threshold_search"):
            assert n == 63
