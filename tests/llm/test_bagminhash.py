"""Near-duplicates against all pairs, signatures against exact similarity, and odd inputs."""

from collections import Counter
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewheel.llm import bagminhash as B
from tidewheel.llm.common import byte_class, gram_hashes, utf8, words

SCHEMA = "doc_id long, text string, lang string, source string, j double, node string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def multiset(text):
    w = WORD.findall(lower(text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute(rows):
    sets = [multiset(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and sets[k] and jaccard(sets[i], sets[k]) >= 0.8:
                at[root(i)] = root(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def test_classes_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(40):
        base = list(rng.choice(vocabulary, int(rng.integers(1, 160))))
        for c in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), (" " if c % 2 else ", ").join(copy).upper() if c % 3 else " ".join(copy)))
    df = spark.createDataFrame([(d, t, "en", "s", 0.0, "x") for d, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in B.classes(df).collect()}
    assert got == brute(rows)


def test_chain_of_small_edits_is_one_class(spark):
    words_ = [f"a{k}" for k in range(120)]
    rows = []
    for step in range(30):
        words_[(step * 7) % 120] = f"b{step}"
        rows.append((step, " ".join(words_)))
    df = spark.createDataFrame([(d, t, "en", "s", 0.0, "x") for d, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in B.classes(df).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " .,"), (4, "same"), (5, "Same"), (5, "Same"), (None, "same"), (7, "word " * 50000), (8, "word " * 50000 + "x")]
    df = spark.createDataFrame([(d, t, None, None, None, None) for d, t in rows], SCHEMA)
    out = B.classes(df).collect()
    assert len(out) == len(rows)
    of = {r.doc_id: r.class_id for r in out}
    assert of[1] == 1 and of[2] == 2 and of[3] == 3 and of[4] == 4 and of[5] == 4 and of[None] == 4 and of[8] == 7
    kept = B.keep_first(df).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 7]
    assert kept[0].asDict().keys() == set(df.columns)
    assert B.classes(df.limit(0)).count() == 0 and B.keep_first(df.limit(0)).count() == 0


@pytest.mark.parametrize("repeat", [1, 3, 9])
def test_signatures_estimate_weighted_similarity(repeat):
    rng = np.random.default_rng(repeat)
    a = " ".join(rng.choice([f"x{k}" for k in range(60)], 300))
    b = a + " tail one two three four five" * repeat
    data, at = utf8(pa.array([a, b]))
    w, first = words(data, at, byte_class("alnum"))
    h, start = gram_hashes(w, first, 5)
    s = B.signatures(h, start, 4000)
    assert abs((s[0] == s[1]).mean() - jaccard(multiset(a), multiset(b))) < 0.04


@pytest.mark.parametrize("limits", [(64, 64), (3, 3), (6, 2), (2, 2)])
def test_a_large_family_with_edits_of_their_own(spark, monkeypatch, limits):
    """A base, many copies of it that are not linked to each other, and copies of copies."""
    monkeypatch.setattr(B, "DIRECT", limits[0])
    monkeypatch.setattr(B, "LEFT", limits[1])
    rng = np.random.default_rng(11)
    rows = []
    for family in range(2):
        base = [f"f{family}w{k}" for k in rng.integers(0, 500, 150)]
        rows.append((len(rows), " ".join(base)))
        for c in range(25):
            copy = list(base)
            for at in rng.choice(150, int(rng.integers(2, 7)), replace=False):
                copy[at] = f"n{family}x{c}y{at}"
            rows.append((len(rows), " ".join(copy)))
            if c % 5 == 0:
                copy[75] = f"again{c}"
                rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame([(d, t, "en", "s", 0.0, "x") for d, t in rows], SCHEMA)
    want = brute(rows)
    assert len(set(want.values())) > 3
    assert {r.doc_id: r.class_id for r in B.classes(df).collect()} == want


def one_round(spark, buckets, of_class, labels=None):
    """(all links found, node pairs that are links) of a round; buckets are lists of sets, the first are the centres."""
    flat = [(k, i, s) for k, bucket in enumerate(buckets) for i, s in enumerate(bucket)]
    label = list(range(len(flat))) if labels is None else labels
    sets = spark.createDataFrame([(n, sorted(s)) for n, (_, _, s) in enumerate(flat)], "node long, grams array<long>")
    open_ = spark.createDataFrame([(k, n, len(s), 1000 - i, label[n]) for n, (k, i, s) in enumerate(flat)], "bucket long, node long, size long, degree long, label long")
    links, pairs, rest = B.centre_round(open_, sets, 0.8, of_class=of_class)
    near = lambda a, b: len(flat[a][2] & flat[b][2]) / len(flat[a][2] | flat[b][2]) >= 0.8
    left = {r.node for r in rest.collect()}
    true = {(a, b) for a in range(len(flat)) for b in range(a) if flat[a][0] == flat[b][0] and near(a, b)}
    found = {(max(r), min(r)) for r in links.collect()} | {(r.a, r.b) for r in pairs.collect() if near(r.a, r.b)}
    return found | {(a, b) for a, b in true if a in left and b in left}, true


def parts(n, edges):
    at = list(range(n))
    for _ in range(n):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    return at


@pytest.mark.parametrize("of_class", [False, True])
def test_links_between_members_below_the_centre(spark, of_class):
    """v, v2, x at 0.84 from v, y at 0.84 from v2 and from x; then random chains, some of them classes already."""
    window = lambda at: set(range(at, at + 90))
    rng = np.random.default_rng(5)
    buckets = [[window(0), window(24), window(8), window(16)]]
    buckets += [[window(int(at)) for at in rng.integers(0, 50, 6)] for _ in range(40)]
    buckets = [[{1000 * k + e for e in s} for s in bucket] for k, bucket in enumerate(buckets)]
    n = sum(map(len, buckets))
    for known in (False, True):
        _, true = one_round(spark, buckets, of_class)
        given = [e for k, e in enumerate(sorted(true)) if k % 2] if known else []
        found, true = one_round(spark, buckets, of_class, parts(n, given))
        assert parts(n, found | set(given)) == parts(n, true)


def test_a_member_at_exactly_the_far_bound(spark):
    """x is at 0.6 from the centre, y at 0.8 from both."""
    found, true = one_round(spark, [[set(range(8)), set(range(2, 10)), set(range(10))]], False)
    assert parts(3, found) == parts(3, true) and len(true) == 2
