"""Operator 12 against a plain ranking of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewheel.llm import threshold

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    counts = [(key, Counter(terms(t))) for key, t in docs]
    counts = [(key, c, sum(c.values())) for key, c in counts if c]
    n_docs, n_all = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c, n in counts:
            m = 100 - 75 + (75 * n * n_docs) // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    words = ["the", "The", "of", "tide", "wheel", "été", "x1", "rare", "mid", *(f"w{k}" for k in range(60))]
    odds = [50, 30, 40, 3, 3, 2, 4, 1, 8, *([2] * 60)]
    docs = [(k, " ".join(rng.choices(words, odds, k=rng.randint(1, 60)))) for k in range(400)]
    docs += [(1000 + k, docs[7][1]) for k in range(40)]  # copies: ties beyond the kth place
    docs += [(None, docs[7][1]), (5, docs[7][1]), docs[3], (2000, None), (2001, ""), (2002, " -!? "), (2003, "z" * 3000), (2004, "wheel " * 50_000), (2005, "a" * 1023 + "b"), (-4, "rare rare rare")]
    items = [(0, "the tide wheel"), (1, "rare rare x1"), (2, docs[7][1]), (3, None), (4, ""), (5, "nothingknown"), (6, "ÉTÉ été"), (6, "of of of w1"), (None, "mid w2"), (7, "z" * 3000), (8, "a" * 1023 + "c"), (9, "the")]
    return docs, items


@pytest.mark.parametrize(("shard", "block"), [(1 << 22, 1 << 22), (50, 1 << 22), (300, 40)])
def test_search_equals_a_plain_ranking(spark, shard, block):
    docs, items = corpus()
    left = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, score int, terms string").repartition(5)
    right = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, rank int")
    got = threshold.search(left, right, shard_postings=shard, block_bytes=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs, items, 10)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{k} long, text string") for k in ("doc_id", "item_id"))
    assert threshold.search(docs.limit(0), items).count() == 0
    assert threshold.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in threshold.search(docs, items, k=1).collect()][0][:3] == (1, 1, 1)


def test_search_stops_before_the_end_of_long_lists():
    n = 50_000
    impact = np.full(n, 100)
    impact[:5] = 1000
    shard = threshold.Shard(np.arange(n), np.zeros(n, bool), np.arange(n + 1), np.zeros(n, np.int64), impact, 1)
    best = threshold.Best(5)
    looked = shard.search(np.array([0]), np.array([3]), best)
    assert best.score.tolist() == [3000] * 5 and best.key.tolist() == [0, 1, 2, 3, 4] and looked < 100
    best = threshold.Best(6)  # the sixth is one of all the others, which are equal
    shard.search(np.array([0]), np.array([3]), best)
    assert best.key.tolist() == [0, 1, 2, 3, 4, 5]
