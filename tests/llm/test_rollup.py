"""Commits of signed counts: repeats, races, compaction, attempts that failed."""

from tidewheel.llm.rollup import DELTA, RollupStore


def sums(spark, *rows):
    return spark.createDataFrame(list(rows), DELTA)


def totals(store):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_batches_count_once(spark, tmp_path):
    store = RollupStore(spark, f"file://{tmp_path}/store")
    assert store.batches() == [] and totals(store) == {}
    assert store.commit("1", sums(spark, ("a", None, "v", 2, 10), (None, "x", "v", 1, 5)))
    assert not store.commit("1", sums(spark, ("a", None, "v", 2, 10)))
    assert store.commit("2", sums(spark, ("a", None, "v", -1, -4)))
    expected = {("a", None, "v"): (1, 6), (None, "x", "v"): (1, 5)}
    assert totals(store) == expected
    store.compact("c")
    assert store.batches() == ["batch=compacted-c"] and totals(store) == expected
    assert not store.commit("2", sums(spark, ("a", None, "v", -1, -4)))
    assert store.commit("3", sums(spark, ("a", None, "v", 1, 1)))
    store.compact("d")
    assert store.batches() == ["batch=compacted-d"] and totals(store) == expected | {("a", None, "v"): (2, 7)}


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    store = RollupStore(spark, f"file://{tmp_path}/store")
    monkeypatch.setattr(RollupStore, "known", lambda self, batch: False)  # both looked before either wrote
    assert store.commit("1", sums(spark, ("a", "x", "v", 1, 10)))
    assert not store.commit("1", sums(spark, ("a", "x", "v", 1, 99)))
    assert totals(store) == {("a", "x", "v"): (1, 10)}
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")) == ["batch=1"]


def test_an_attempt_that_failed_is_not_seen(spark, tmp_path):
    store = RollupStore(spark, f"file://{tmp_path}/store")
    sums(spark, ("a", "x", "v", 1, 99)).write.parquet(f"file://{tmp_path}/store/attempt-0/sums")
    assert store.batches() == [] and store.commit("1", sums(spark, ("a", "x", "v", 1, 10)))
    assert totals(store) == {("a", "x", "v"): (1, 10)}


def test_versions_by_tokenizer_files_count_what_the_library_does(spark):
    from tokenizers import Tokenizer

    from tidewheel.llm import bpe, rans, rollup

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "text")
    odd = spark.createDataFrame([(-1, "a", None, None), (-2, "a", "en", ""), (-3, None, "en", "x\nx\ny " + "long " * 20_000)], "doc_id long, source string, lang string, text string")
    docs = docs.select("doc_id", "source", "lang", "text").union(odd.select("doc_id", "source", "lang", "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    distinct = lambda t: "\n".join(dict.fromkeys(t.split("\n")))
    own = {"byte-bpe-50k": Tokenizer.from_file(bpe.vocabulary_path()), "word-bpe-49k": Tokenizer.from_file(rans.vocabulary_path())}
    for t in own.values():
        t.no_truncation()
        t.no_padding()
    size = lambda v, t: len(own[v].encode(t, add_special_tokens=False).ids)
    rows = rollup.changes(docs, versions=rollup.tokenizers()).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.n_tokens == size(r.version, text) and r.n_revised == size(r.version, distinct(text)) and r.revised == (distinct(text) != text)
