"""Operator 8: planted outliers of each measure, small groups, odd texts."""

import random

from pyspark.sql import functions as F

from tidewheel.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rng, n=120, words=None):
    words = words or ["tide", "wheel", "river", "stone", "amber", "cloud", "field", "water", "light", "stern"]
    made = [rng.choice(words) + rng.choice("abcdefghijk") for _ in range(n)]
    return "\n".join(" ".join(made[k : k + 12]) for k in range(0, n, 12))


def corpus(rng):
    lines = [f"line{k:02d}" for k in range(40)]
    docs = [(k, prose(rng), "en", "web" if k % 3 else "books") for k in range(300)]
    return docs, [
        (1000, prose(rng, words=["extraordinarily" * 2]), "en", "web"),  # long words
        (1001, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150)), "en", "web"),  # words of a letter
        (1002, prose(rng).replace(" ", "# "), "en", "web"),
        (1003, "\n".join(w for _ in range(4) for w in rng.sample(lines, len(lines))), "en", "web"),  # duplicate lines, but hardly a window twice
    ]


def test_outliers_of_each_measure_fail(spark):
    rng = random.Random(3)
    docs, odd = corpus(rng)
    half = prose(rng, 66).split()
    odd.append((1004, " ".join([*half, *prose(rng, 66).split(), *half[:54]]), "en", "web"))  # 108 of 186 words in repeated windows would fail the base rule
    odd.append((1005, " ".join([*half, *prose(rng, 70).split(), *half[:42]]), "en", "web"))  # 84 of 178: the base rule passes it
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(docs + odd, SCHEMA)).collect()}
    assert all(got[k].kept for k in range(300))
    assert {k: (got[k].base_failed, got[k].kept) for k in (1000, 1001, 1002, 1003, 1005)} == dict.fromkeys((1000, 1001, 1002, 1003, 1005), (False, False))
    assert got[1004].base_failed and not got[1004].kept


def test_small_groups_lean_on_wider_ones(spark):
    """A group's fence moves with its rows from the wider fence to its own; there is no size at which it jumps."""
    rng = random.Random(5)
    wide = [(k, prose(rng), "en", "web") for k in range(400)]
    code = lambda n: [(1000 + k, prose(rng).replace(" ", " | ", 30), "en", "code") for k in range(n)]
    shares = []
    for n in (1, 60, 99, 100, 101, 400):
        rows = quality.judge(spark.createDataFrame(wide + code(n), SCHEMA)).filter("source = 'code'")
        shares.append(rows.agg(F.avg(F.col("kept").cast("double"))).first()[0])
    assert shares[-1] == 1.0 and shares[0] == 0.0 and shares == sorted(shares)


def test_long_text_ties_and_nulls(spark):
    rng = random.Random(7)
    rows = [(1, prose(rng, 60_000), "en", "a"), (2, None, None, None), (3, "", "en", None), (4, prose(rng), None, "a"), (4, prose(rng), None, "a"), (5, "word " * 60_000, "en", "a"), (6, "x" * 300_000, "en", "a")]
    got = {}
    for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.base_failed, r.kept))
    assert got[1] == [(60_000, False, True)] and got[2] == [(0, True, False)] and got[3] == [(0, True, False)]
    assert got[4] == [(120, False, True)] * 2 and got[5] == [(60_000, True, False)] and got[6] == [(1, True, False)]
