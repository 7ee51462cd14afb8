"""The pipeline's stages against plain versions of what each decides, and odd tables through all of them."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import bpe, language, secrets
from tidewheel.llm.common import materialise, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def kept_of_classes(rows):
    """One row of each class of texts whose 5-word shingles are similar by 0.8 or more, that with the least key."""
    sets = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else Counter() for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            if a and sets[k] and sum((a & sets[k]).values()) >= 0.8 * sum((a | sets[k]).values()):
                up[root(i)] = root(k)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    return {min(keys) for keys in least.values()}


def contaminated(text, windows, sizes):
    w, hit = words(text), set()
    for k in range(len(w)):
        for n in sizes:
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_equal_plain_versions(spark):
    planted = F.concat("text", F.lit(" token = "), F.sha2(F.col("doc_id").cast("string"), 256), F.lit(" and so on"))
    docs = table(spark, SF, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 3, planted).otherwise(F.col("text")))
    bench = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[k : k + min(13, len(w))]) for w in bench if w for k in range(len(w) - min(13, len(w)) + 1)}
    sizes = {len(x) for x in windows}
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    # what the model says of each text decides; the rest needs no model
    model = language.train(docs.filter(~language.held_out()))
    said = {r.doc_id: (r.f.lang_pred, r.f.score) for r in language.identify(docs, model, into="f").select("doc_id", "f").collect()}
    first = materialise(stages["language ID"](spark, docs, SF), "test")
    assert set(rows(first)) == {k for k, (lang, score) in said.items() if lang != "und" and score >= 0.5}
    second = materialise(stages["near duplicates"](spark, first, SF), "test")
    kept = kept_of_classes(sorted(rows(first).items()))
    assert rows(second) == {k: t for k, t in rows(first).items() if k in kept}
    third = materialise(stages["decontamination"](spark, second, SF), "test")
    assert rows(third) == {k: t for k, t in rows(second).items() if not contaminated(t, windows, sizes)}
    fourth = materialise(stages["secret scan"](spark, third, SF), "test")
    live = defaultdict(list)
    for r in secrets.classify(third).collect():
        live[r.doc_id] += [(s.begin, s.end) for s in r.spans if s.verdict == "live"]
    want = {}
    for k, text in rows(third).items():
        out, at = "", 0
        for begin, end in sorted(live[k]):
            if begin >= at:
                out += (text or "")[at:begin] + "[SECRET]"
            at = max(at, end)
        want[k] = out + (text or "")[at:]
    assert rows(fourth) == want and any("[SECRET]" in t for t in want.values())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    last = {r.doc_id: r for r in stages["BPE"](spark, fourth, SF).collect()}
    assert set(last) == set(want)
    for k, text in want.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert (last[k].n_tokens, last[k].ids_sha256, last[k].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables_pass_every_stage(spark, tmp_path, empty):
    """Nulls in every column, empty and long texts, repeated rows, clashing names; then no rows at all."""
    clash = ("language", "coded", "verbatim", "__row_key", "__key", "__live", "__done", "node", "lang_pred", "found", "bands", "spans")
    base = table(spark, SF, "documents").limit(40)
    null = lambda c, n: F.when(F.col("doc_id") % n == 0, None).otherwise(F.col(c)).alias(c)
    text = F.when(F.col("doc_id") % 9 == 0, None).when(F.col("doc_id") % 9 == 1, "").when(F.col("doc_id") % 9 == 2, F.repeat("text", 12)).otherwise(F.col("text"))
    odd = base.select(null("doc_id", 11), text.alias("text"), null("lang", 7), null("source", 6), null("n_chars", 3), *(F.lit(k).alias(c) for k, c in enumerate(clash)))
    odd = odd.union(odd.limit(3)).limit(0 if empty else 100)
    for name in ("benchmark", "labels"):
        table(spark, SF, name).limit(0 if empty else 10**6).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = materialise(odd, "test")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = materialise(stage(spark, docs, str(tmp_path)), "test")
        assert out.count() <= before and (not empty or out.count() == 0)
        if name != "BPE":
            assert out.columns == docs.columns
            pairs = lambda df: Counter(tuple(r) for r in df.select("doc_id", "lang", "source", "n_chars", *(f"`{c}`" for c in clash)).collect())
            assert not pairs(out) - pairs(docs)
        docs = out
    assert empty or docs.count() > 5
