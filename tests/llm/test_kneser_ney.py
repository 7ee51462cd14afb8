"""The model against a plain one in dictionaries, its probabilities' sum, and odd rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewheel.llm import kneser_ney as K

SCHEMA = "doc_id long, text string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), "</s>"]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.counts = {order: Counter()}
        raw = Counter()
        for t in texts:
            tokens = tokens_of(t)
            raw.update(tokens)
            padded = ["<s>"] * (order - 1) + tokens
            self.counts[order].update(tuple(padded[i : i + order]) for i in range(len(tokens)))
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.raw, self.size = raw, len(raw) + 1  # raw holds the end; one more for the unknown
        self.d, self.ctx = {}, {}
        for n, c in self.counts.items():
            k = Counter(c.values())
            y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else 0.5
            self.d[n] = [0.0] + [min(max(j - (j + 1) * y * k[j + 1] / k[j] if k[j] else j / 2, 0.1), j - 0.1) for j in (1, 2, 3)]
            ctx = defaultdict(lambda: [0, 0, 0, 0])
            for g, x in c.items():
                ctx[g[:-1]][0] += x
                ctx[g[:-1]][min(x, 3)] += 1
            self.ctx[n] = ctx

    def p(self, gram):
        out = 1 / self.size
        for n in range(1, self.order + 1):
            g = gram[-n:]
            s = self.ctx[n].get(g[:-1])
            if s is None:
                continue
            d, c = self.d[n], self.counts[n][g]
            out = max(c - d[min(c, 3)], 0) / s[0] + sum(d[k] * s[k] for k in (1, 2, 3)) / s[0] * out
        return out

    def score(self, text):
        tokens = tokens_of(text)
        padded = ["<s>"] * (self.order - 1) + tokens
        return sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(tokens)))


def texts(seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"W{k}" for k in range(30)]
    return [" ".join(rng.choice(vocabulary, int(rng.integers(0, 40)), p=np.arange(30, 0, -1) / 465)) for _ in range(60)] + [None, "", "w1\tw2\nw3  W4", "w1 w2 w3 w4"]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_a_plain_model(spark, order):
    rows = texts()
    train = spark.createDataFrame([(k, t, 0.0) for k, t in enumerate(rows)], SCHEMA)
    model = K.train(train, order=order)
    plain = Plain(rows, order)
    probe = [*rows[:10], "new words w1 w2", "w1 new w2", None, "é " * 50]
    got = K.score(spark.createDataFrame([(k, t, 0.0) for k, t in enumerate(probe)], SCHEMA), model).collect()
    n, v = sum(plain.raw.values()), len(plain.raw)
    assert (model.tokens, model.types) == (n, v)
    for r in got:
        assert r.score == pytest.approx(plain.score(probe[r.doc_id]), abs=1e-9)
        t = tokens_of(probe[r.doc_id])
        assert r.n_tokens == len(t) and r.n_known == sum(plain.raw[x] > 0 for x in t)
        assert r.base_score == pytest.approx(sum(math.log10((plain.raw[x] + 1) / (n + v + 1)) for x in t))


def test_probabilities_sum_to_one(spark):
    model = K.train(spark.createDataFrame([(k, t, 0.0) for k, t in enumerate(texts())], SCHEMA))
    everything = np.array([0, 2, *range(3, model.types - 1 + 3)], np.uint32)
    for context in (0, 1, 3, 7):
        p = model.probabilities([np.full(len(everything), context, np.uint32), everything])
        assert p.sum() == pytest.approx(1.0)


@pytest.mark.parametrize("most", [200, 60_000, 1 << 20, 1 << 40])
def test_counts_of_any_width_survive_blocks(most):
    columns = [np.array([3, 3, 9], np.uint32), np.array([4, 7, 2], np.uint32)]
    got, counts = K.unpack(K.pack(columns, np.array([1, most, 5])))
    assert [c.tolist() for c in got] == [c.tolist() for c in columns] and counts.tolist() == [1, most, 5]


def test_contexts_seen_more_than_two_to_the_32_times(spark, tmp_path):
    """One partition's blocks with a count of 2^33: stored totals and followers still give a whole distribution."""
    columns = [np.array([5, 5, 5], np.uint32), np.array([2, 6, 7], np.uint32)]
    block = K.pack(columns, np.array([1, 1 << 33, 3]))
    blocks = spark.createDataFrame([(0, bytearray(block))], "p int, block binary")
    levels = {}
    for n in (2, 1):
        stored = blocks.groupBy("p").applyInArrow(K._keep_grams(str(tmp_path), n, 1), K.STATS).cache()
        levels[n] = K._level(str(tmp_path), stored, n, 1)
        blocks = stored.filter("block is not null").select("p", "block")
    model = K.Model(2, 1, K.Arrays(str(tmp_path), [None]), np.zeros(1, np.int64), 1, 10, 6, levels)
    everything = np.array([0, 2, 3, 4, 5, 6, 7], np.uint32)
    p = model.probabilities([np.full(7, 5, np.uint32), everything])
    assert levels[2].total == (1 << 33) + 4
    assert p.sum() == pytest.approx(1.0) and p[5] > 0.999999


def test_empty_training_and_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = K.train(none)
    assert K.score(none, model).count() == 0
    got = K.score(spark.createDataFrame([(1, "a b", 0.0)], SCHEMA), model).first()
    assert got.n_known == 0 and got.base_score == 0.0 and got.score < 0


def test_long_text(spark):
    rows = [(1, "alpha beta " * 200_000, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = K.score(df, K.train(df)).first()
    assert got.n_tokens == 400_001 and got.score > got.base_score


def test_the_query_uses_two_words_of_context(spark, tmp_path):
    """x is followed by z after a and by w after b: only an order above 2 tells them apart."""
    rows = [(k, "a x z" if k % 2 else "b x w", 0.0) for k in range(400)]
    probes = [(k, t, 0.0) for j, t in enumerate(("a x z", "a x w")) for k in range(1000 + 500 * j, 1030 + 500 * j)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    held = [r.doc_id for r in spark.createDataFrame(probes, SCHEMA).filter(K.held_out()).collect()]
    spark.createDataFrame([p for p in probes if p[0] in held], SCHEMA).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.perplexity for r in K.op4_kneser_ney(spark, str(tmp_path)).collect()}
    seen, unseen = (min(got[d] for d in held if (d < 1500) == first) for first in (True, False))
    assert seen < 0.7 * unseen
