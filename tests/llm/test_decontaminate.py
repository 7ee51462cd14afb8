"""Benchmark matches against a plain search, in one block and in many."""

import re

import pytest

from tidewheel.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, items, window=13):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, other in items:
        b = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), other or ""))
        n = min(window, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == b[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [4 << 20, 150])
def test_blocks_equal_a_plain_search(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    passage = " ".join(f"w{k}" for k in range(30))
    items = [("a", passage), ("b", passage.upper()), ("b", passage.upper()), ("c", "Only three words"), ("d", ""), ("e", None), ("f", "w1 w2 w3 other " * 6), ("ü", "größe zählt doch")]
    docs = [(1, f"before {passage} after"), (2, None), (3, ""), (4, "only, three; WORDS and only three words"), (5, passage[:40]), (6, "w1 w2 w3 other " * 9), (7, "x " * 400 + passage + " y" * 5000), (1, "Größe zählt doch nicht"), (None, passage)]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    assert (len(decontaminate.blocks_of(b, 13, "item_id", "text")[1]) > 1) == (block_bytes < 1000)
    got = decontaminate.verbatim_matches(d, b).collect()
    for r in got:
        v = r.verbatim
        assert (v.n_words, v.n_hit, list(v["items"])) == plain(r.text, items)
        w = WORD.findall((r.text or "").lower())
        for m in v.matches:
            texts = [WORD.findall((t or "").lower())[m["item_word"] : m["item_word"] + m.n_words] for i, t in items if i == m["item"]]
            assert w[m.doc_word : m.doc_word + m.n_words] in texts
    whole = next(r for r in got if r.doc_id == 7).verbatim.matches
    assert sorted((m["item"], m.doc_word, m["item_word"], m.n_words) for m in whole) == [("a", 400, 0, 30), ("b", 400, 0, 30)]


def test_no_benchmark(spark):
    d = spark.createDataFrame([(1, "some words")], "doc_id int, text string")
    b = spark.createDataFrame([], "item_id string, text string")
    assert [(r.verbatim.n_words, r.verbatim.n_hit, r.verbatim["items"]) for r in decontaminate.verbatim_matches(d, b).collect()] == [(2, 0, [])]
