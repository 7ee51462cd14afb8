"""Operator 13 against plain fingerprints and all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewheel.llm import simhash

BITS = range(64)


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in BITS if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(fps):
    """The least key that links of three bits or fewer reach, for (key, fingerprint) by all pairs."""
    distinct = sorted({f for _, f in fps})
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            up[f] = f = up[up[f]]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for k, f in fps:
        if k is not None:
            least[root(f)] = min(k, least.get(root(f), k))
    return sorted(((k, f, least.get(root(f))) for k, f in fps), key=str)


def texts():
    rng = random.Random(5)
    words = ["ab", "Cd", "éf", "x" * 40, "lorem", "\x00", "ZZ", "1,2"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    near = []
    for b in base[:20]:
        w = (b + " tail").split(" ")
        near += [" ".join(w[:k] + ["neu"] + w[k + 1 :]) for k in range(0, len(w), 7)]
    odd = [None, "", " \n\t", "one", "One", "one two", "one\ttwo", " ", "long " * 40_000, "y" * 300_000]
    return [*base, *base[:5], *near, *odd]


def test_fingerprints_and_components_equal_all_pairs(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts())]
    rows += [(None, "one", "x"), (None, "nobody else says this one", "x"), *rows[:3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = labels([(k, plain(t)) for k, t, _ in rows])
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def balls():
    """Fingerprints close to few centres, chains of three bits, and lone ones: crowded buckets of every kind."""
    rng = random.Random(7)
    out = {0, (1 << 64) - 1}
    for centre in (rng.getrandbits(64), rng.getrandbits(64), 0):
        for _ in range(250):
            f = centre
            for b in rng.sample(BITS, rng.choice([1, 2, 3, 3, 4, 5, 6, 8])):
                f ^= 1 << b
            out.add(f)
    chain = rng.getrandbits(64)
    for b in rng.sample(BITS, 30):
        out.add(chain := chain ^ (1 << b))
    out |= {rng.getrandbits(64) & ~0xFFFF for _ in range(200)}
    return sorted(out)


@pytest.mark.parametrize(("split", "limit"), [(4096, 32768), (40, 32768), (40, 25), (2, 2)])
def test_links_do_not_depend_on_the_way(spark, split, limit):
    fps = balls()
    want = {f: c for _, f, c in labels(list(enumerate(fps)))}
    key = {f: k for k, f in enumerate(fps)}
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    out = simhash.links(df, split=split, limit=limit).collect()
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for r in out:
        a, b = root(r.a % 2**64), root(r.b % 2**64)
        up[max(a, b)] = min(a, b)
    groups = {}
    for f in fps:
        groups.setdefault(root(f), []).append(key[f])
    assert {key[f]: min(groups[root(f)]) for f in fps} == {key[f]: want[f] for f in fps}


def test_query_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.op13_simhash(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got.collect()) == sorted(labels(docs))
    assert got.filter(F.length("fingerprint") != 16).count() == 0
