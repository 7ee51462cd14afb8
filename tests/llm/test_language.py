"""Language ID: words against a pattern, Viterbi against all paths, odd texts, mixed languages."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
import regex

from tidewheel.llm import language as L
from tidewheel.llm.common import utf8

TEXTS = ["Der Hund, the DOG!", "", None, "²½ 12 Ⅷ", "́áb c", "नमस्ते दुनिया", "สวัสดี", "x" * 3000, "İstanbul ΣΑΣ", "日本 and 日本", " a", "b"]


@pytest.mark.parametrize("window", [7, 1 << 20])
def test_words_are_those_of_the_pattern(monkeypatch, window):
    monkeypatch.setattr(L, "WINDOW_BYTES", window)
    w = L.Words(*utf8(pa.array(TEXTS, pa.string())))
    for k, t in enumerate(TEXTS):
        want = [m.span() for m in regex.finditer(r"\p{L}[\p{L}\p{M}]*", t or "")]
        rows = slice(w.first[k], w.first[k + 1])
        begin = w.begin[rows] - w.origin[k]
        assert list(zip(begin.tolist(), (begin + w.size[rows]).tolist(), strict=True)) == want
        for i, (a, b) in zip(w.which[rows].tolist(), want, strict=True):
            got = w.letters[w.place[i] : w.place[i] + w.length[i]].astype("<u4").tobytes().decode("utf-32-le")
            assert got.casefold() == t[a:b].replace("İ", "i").casefold()


def best(s, penalty):
    return max(sum(s[t][x] for t, x in enumerate(p)) - penalty * sum(a != b for a, b in itertools.pairwise(p)) for p in itertools.product(range(len(s[0])), repeat=len(s)))


def test_label_is_the_best_of_all_paths(monkeypatch):
    monkeypatch.setattr(L, "FEW", 3)
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 7, 60)
    first = np.concatenate([[0], np.cumsum(sizes)])
    s = rng.normal(0, 5, (first[-1], 3)).astype(np.float32)
    path = L.label(s, first, 8.0)
    for k, n in enumerate(sizes.tolist()):
        if n:
            own, p = s[first[k] : first[k + 1]], path[first[k] : first[k + 1]]
            value = sum(own[t][x] for t, x in enumerate(p)) - 8.0 * (np.diff(p) != 0).sum()
            assert abs(value - best(own.tolist(), 8.0)) < 1e-3


def test_spans_of_a_mixed_text_and_odd_rows(spark):
    english = "the quick brown fox was running over that hill with them and they were there"
    german = "und der schnelle braune Fuchs läuft über den Hügel mit ihnen weil sie dort waren"
    greek = "και η γρήγορη αλεπού τρέχει πάνω από τον λόφο"
    rows = [(k, t, g) for k, (t, g) in enumerate([(english, "en"), (german, "de"), (greek, "el")] * 5)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = f"{english}. {german}! {greek}"
    asked = [(1, mixed), (2, None), (3, "12 ² Ⅷ"), (4, ""), (None, german), (None, german), (7, "日本"), (8, greek.upper())]
    got = L.identify(spark.createDataFrame(asked, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS lang_pred"), model).collect()
    assert len(got) == len(asked)
    of = {r.doc_id: r.language for r in got}
    spans = [(s.lang, mixed[s.begin : s.end]) for s in of[1].lang_spans]
    assert spans == [("en", english), ("de", german), ("el", greek)]
    letters = [sum(map(len, regex.findall(r"\p{L}+", t))) for t in (english, german, greek)]
    assert of[1].score == pytest.approx(max(letters) / sum(letters))
    for k in (2, 3, 4):
        assert (of[k].lang_pred, of[k].score, of[k].lang_spans) == ("und", 0.0, [])
    assert of[None].lang_pred == "de" and of[8].lang_pred == "el" and of[7].lang_pred == "de"
    none = L.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.language.lang_pred for r in L.identify(spark.createDataFrame(asked, "doc_id long, text string"), none).collect()} == {"und"}


def test_a_language_of_which_the_sample_has_no_words(spark):
    rows = [(k, "plain words of one language", "en") for k in range(9)] + [(9, "123", "zz"), (10, None, "yy")]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = L.identify(spark.createDataFrame([(1, "plain words")], "doc_id long, text string"), model).first()
    assert got.language.lang_pred == "en"


def test_very_many_languages(spark):
    rows = [(k, " ".join(3 * (chr(97 + k // 20) + chr(97 + k % 20) + x) for x in "abc"), f"l{k:03d}") for k in range(300)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300
    got = L.identify(spark.createDataFrame([(rows[k][0], rows[k][1]) for k in (3, 250)], "doc_id long, text string"), model).collect()
    assert [r.language.lang_pred for r in got] == ["l003", "l250"]


def test_two_switches_that_only_pay_together():
    s = np.array([[6.0, -20.0, 0.0], [-20.0, 6.0, 0.0]])
    assert L.label(s, np.array([0, 2]), 8.0).tolist() == L.viterbi(s, 8.0).tolist() == [0, 1]


def test_label_equals_viterbi_on_random_scores():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        s = rng.normal(0, rng.uniform(0.2, 4), (int(rng.integers(1, 12)), int(rng.integers(1, 5))))
        value = lambda p: sum(s[t][x] for t, x in enumerate(p)) - 8.0 * (np.diff(p) != 0).sum()  # noqa: E731, B023
        assert abs(value(L.label(s, np.array([0, len(s)]), 8.0)) - value(L.viterbi(s, 8.0))) < 1e-6


def test_label_equals_viterbi_on_long_texts(monkeypatch):
    """Long texts of one language with foreign stretches, all at once."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 400, 60)
    first = np.concatenate([[0], np.cumsum(sizes)])
    main = np.repeat(rng.integers(0, 4, 60), sizes)
    for k in range(200):
        a = int(rng.integers(0, first[-1]))
        main[a : a + int(rng.integers(1, 25))] = k % 4
    s = rng.normal(0, 3, (first[-1], 4))
    s[np.arange(len(s)), main] += 2.5
    path = L.label(s, first, 8.0)
    for a, b in itertools.pairwise(first.tolist()):
        if a < b:
            value = lambda p: s[a:b][np.arange(b - a), p].sum() - 8.0 * (np.diff(p) != 0).sum()  # noqa: E731, B023
            assert abs(value(path[a:b]) - value(L.viterbi(s[a:b], 8.0))) < 1e-6
