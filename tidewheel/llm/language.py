r"""Operator 2: language identification of spans, by script and Viterbi.

A word's scripts, from ranges of code points, narrow its candidate languages to
those whose training text uses them all (or, for a word of scripts that no
language joins, any). Each candidate scores the word by the log odds of its
character trigrams. Viterbi over the words, with a penalty for each switch of
language, labels the text; runs of one label are its spans.

Everything works on arrays of a slice's code points: letters, case and script
come from tables, words are told apart by hash, each different word of a slice is
scored once, and Viterbi steps through the mixed texts of a slice together. So a
task needs memory for a slice, however many words the corpus has.

Few words need the table. Let C be the best single language of a text, m the best
score of any other language less that of C, word by word, and let the sum of m
over every stretch that ends with a word be negative (over the stretch from the
text's begin, below one penalty). Then no path in another language at this word
is within a penalty of the best one in C, so some best path has C there. Between
such words lie blocks. A path that leaves C inside a block pays two penalties, at
a border of the text one; a block whose sums of m cannot pay for that is all C.
Viterbi steps through the other blocks only, C being given at their borders.

Training counts trigrams, hashed into TABLE buckets for each language, over a
bounded sample of the labelled rows: those with the least hash of key, about
max_docs of each language (a parameter). The driver gets the counters summed by
bucket: 256 KB a language, whatever the size of the corpus.

Words are runs [\p{L}][\p{L}\p{M}]* in lower case. Defined cases: null text, or
text without letters, is `und` with score 0 and no spans; letters of a script
that no language was trained on are neutral, and if all are, the text gets the
most frequent training language; rows without a label don't train; if none
trains, every text is `und`; repeated rows are each labelled; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WINDOW_BYTES, arrow_column, hash_pieces, mix, pieces, slices, table, thrifty, utf8

MAX_DOCS = 3000
TABLE = 1 << 16
PENALTY = 8.0
CAP = 6.0
LETTER, MARK = 1, 2

#: Code-point ranges of scripts.
SCRIPTS = (
    ("Latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("Devanagari", ((0x900, 0x97F),)),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Telugu", ((0xC00, 0xC7F),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("Hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("Ethiopic", ((0x1200, 0x137F),)),
    ("Khmer", ((0x1780, 0x17FF),)),
    ("Kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("Han", ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
OTHER = len(SCRIPTS)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind (0, LETTER or MARK), lower case, script."""
    import regex

    points = np.delete(np.arange(0x110000, dtype=np.uint32), np.s_[0xD800:0xE000])
    every = points.tobytes().decode("utf-32-le")
    kind, lower, script = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.full(0x110000, OTHER, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{M}+", MARK)):
        for m in regex.finditer(pattern, every):
            kind[points[m.start() : m.end()]] = value
    dotted = every.index("\u0130")  # the only letter whose lower case is two code points
    lower[points] = np.frombuffer((every[:dotted] + "i" + every[dotted + 1 :]).lower().encode("utf-32-le"), np.uint32)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            script[a : b + 1] = k
    return kind, lower, script


class Words:
    """Words of a run of texts: first word of each text, place and size in code points, which different word."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        kind, lower, self.script_of = tables()
        first = np.zeros(len(at), np.int64)
        begins, sizes, hashes, kept = [], [], [], []
        pos = points = total = held = 0
        while pos < len(data):
            end = min(pos + WINDOW_BYTES, len(data))
            if end < len(data):  # windows end after a byte that no word holds, or go on to the next one
                split = np.flatnonzero(_ASCII_SPLIT[data[pos:end]])
                while not len(split) and end < len(data):
                    end = min(end + WINDOW_BYTES, len(data))
                    split = np.flatnonzero(_ASCII_SPLIT[data[pos:end]])
                end = pos + int(split[-1]) + 1 if len(split) and end < len(data) else end
            raw = data[pos:end]
            cp = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each code point
            k = kind[cp]
            lo, hi = np.searchsorted(at, [pos, end], "left")
            edge = np.searchsorted(starts, at[lo:hi] - pos)
            inside = k != 0
            cut = np.zeros(len(cp) + 1, bool)
            cut[edge] = cut[0] = cut[-1] = True
            before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
            head = np.flatnonzero(inside & ~before)
            after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
            stop = np.flatnonzero(inside & ~after) + 1
            if (k[head] == MARK).any():  # marks before the first letter belong to no word
                letters = np.append(np.flatnonzero(k == LETTER), len(cp))
                head = letters[np.searchsorted(letters, head)]
                some = head < stop
                head, stop = head[some], stop[some]
            low = lower[cp]
            h = hash_pieces(mix(low + np.uint64(1)), head, stop)
            if hi > lo:
                first[lo:hi] = total + np.searchsorted(head, edge, "left")
            begins.append(head + points)
            sizes.append(stop - head)
            hashes.append(h)
            each, rank = np.unique(h, return_index=True)
            chosen = np.zeros(len(cp) + 1, np.int64)
            np.add.at(chosen, head[rank], 1)
            np.add.at(chosen, stop[rank], -1)
            body = np.cumsum(chosen[:-1]) > 0
            where = np.cumsum(body) - 1
            kept.append((low[body], where[head[rank]] + held, (stop - head)[rank], each))
            held += int(body.sum())
            total += len(head)
            points += len(cp)
            pos = end
        first[np.searchsorted(at, len(data), "left") :] = total
        if not len(data):
            first[:] = 0
        joined = lambda xs, kind_: np.concatenate(xs) if xs else np.zeros(0, kind_)
        self.first, self.begin, self.size = first, joined(begins, np.int64), joined(sizes, np.int64)
        self.letters = joined([x[0] for x in kept], np.uint32)
        #: place and size of each different word in `letters`, and which of them each word is
        each, rank = np.unique(joined([x[3] for x in kept], np.uint64), return_index=True)
        self.place, self.length = joined([x[1] for x in kept], np.int64)[rank], joined([x[2] for x in kept], np.int64)[rank]
        self.which = np.searchsorted(each, joined(hashes, np.uint64))
        #: code points before each text
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.origin = ends[at]

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of the trigrams of every different word with its borders, first of each word)."""
        start = np.concatenate([[0], np.cumsum(self.length)])
        own = np.repeat(self.place - start[:-1], self.length) + np.arange(start[-1])
        middle = self.letters[own].astype(np.uint64)
        left, right = np.empty_like(middle), np.empty_like(middle)
        left[1:], right[:-1] = middle[:-1], middle[1:]
        left[start[:-1]] = right[start[1:] - 1] = 32
        h = (left * np.uint64(0x9E3779B97F4A7C15) + middle) * np.uint64(0xD1342543DE82EF95) + right
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64) & (TABLE - 1), start

    def scripts(self) -> np.ndarray:
        """Script of each code point of the different words, in the order of trigrams(); -1 for a mark."""
        start = np.concatenate([[0], np.cumsum(self.length)])
        own = self.letters[np.repeat(self.place - start[:-1], self.length) + np.arange(start[-1])]
        return np.where(tables()[0][own] == LETTER, self.script_of[own].astype(np.int64), -1)


_ASCII_SPLIT = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


class Model:
    """Log odds of trigram buckets by language, and which scripts a language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        if not langs:
            return
        p = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * TABLE))
        p -= np.log(np.exp(p).mean(axis=0))
        self.odds = np.clip(p, -CAP, CAP).T.astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        #: of each script, the languages that use it in a hundredth of their letters or more; any for a mark, which is last
        self.candidate = np.concatenate([(share >= 0.01).T, np.ones((1, len(langs)), bool)])
        self.default = int(np.argmax(scripts.sum(axis=1)))

    def scores(self, words: Words) -> np.ndarray:
        """Scores of every different word by language; where no language uses its scripts all are 0."""
        buckets, start = words.trigrams()
        if not len(buckets):
            return np.zeros((0, len(self.langs)), np.float32)
        s = np.clip(np.add.reduceat(self.odds[buckets], start[:-1], axis=0), -2 * CAP, 2 * CAP)
        scripts = words.scripts()
        may = np.logical_and.reduceat(self.candidate[scripts], start[:-1], axis=0)
        none = np.flatnonzero(~may.any(axis=1))
        if len(none):
            letters = self.candidate[scripts] & (scripts >= 0)[:, None]
            may[none] = np.logical_or.reduceat(letters, start[:-1], axis=0)[none]
        s -= np.where(may, s, -np.inf).max(axis=1, keepdims=True, initial=-1e30)
        s[~may] = -4 * CAP
        s[~may.any(axis=1)] = 0
        return s


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of scores when each change of label costs the penalty; ties stay."""
    own = list(range(s.shape[1]))
    here = [float(x) for x in s[0]]
    back: list[list[int]] = [own]
    for row in s[1:].tolist():
        top = max(here)
        jump = top - penalty
        if min(here) >= jump:
            back.append(own)
        else:
            best = here.index(top)
            back.append([k if x >= jump else best for k, x in zip(own, here, strict=True)])
            here = [x if x >= jump else jump for x in here]
        here = [x + y for x, y in zip(here, row, strict=True)]
    path = np.empty(len(s), np.int64)
    label = here.index(max(here))
    for t in range(len(s) - 1, -1, -1):
        path[t] = label
        label = back[t][label]
    return path


#: So many of the longest blocks are stepped through one by one, all others together.
FEW = 8


def label(s: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """viterbi() of every text, whose rows of scores begin at `first`."""
    some = np.flatnonzero(np.diff(first) > 0)
    if not len(some) or s.shape[1] < 2:
        return np.zeros(len(s), np.int64)
    begin, size, rows = first[some], np.diff(first)[some], np.arange(len(s))
    best = np.argmax(np.add.reduceat(s, begin, axis=0, dtype=np.float64), axis=1)
    of = np.repeat(np.arange(len(some)), size)
    path = best[of]
    other = s.copy()
    other[rows, path] = -np.inf
    m = other.max(axis=1).astype(np.float64) - s[rows, path]
    upto = np.cumsum(m)
    upto -= (upto - m)[begin][of]  # of the text's own words
    # texts are put below those before, so that a running minimum is one of the text's own
    shift = 2 * (np.abs(m).max() * size.max() + 1.0) * of
    rise = upto - shift - np.minimum.accumulate(upto - m - shift)
    sure = (rise <= 0) & (upto <= -penalty)
    edge = np.zeros(len(s) + 1, bool)
    edge[begin] = edge[-1] = True
    head = np.flatnonzero(~sure & (np.concatenate([[True], sure[:-1]]) | edge[:-1]))
    if not len(head):
        return path
    stop = np.flatnonzero(~sure & (np.concatenate([sure[1:], [True]]) | edge[1:])) + 1
    opens, closes = edge[head], edge[stop]
    limit = penalty - 1e-3
    hard = (np.maximum.reduceat(rise, head) >= 2 * limit) | (opens & (np.maximum.reduceat(upto, head) >= limit)) | (closes & (rise[stop - 1] >= limit))
    head, stop, opens, closes = head[hard], stop[hard], opens[hard], closes[hard]
    if not len(head):
        return path
    length = stop - head
    start = np.concatenate([[0], np.cumsum(length)])
    where = np.repeat(head - start[:-1], length) + np.arange(start[-1])
    part = s[where].astype(np.float64)
    away = np.full((len(head), s.shape[1]), -penalty)
    away[np.arange(len(head)), path[head]] = 0
    part[start[:-1][~opens]] += away[~opens]
    part[start[1:][~closes] - 1] += away[~closes]
    path[where] = together(part, start, penalty)
    return path


def together(s: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """viterbi() of blocks of rows, a row of all blocks at a time but for the longest few."""
    path = np.empty(len(s), np.int64)
    order = np.argsort(first[:-1] - first[1:], kind="stable")  # longest first
    for k in order[:FEW].tolist():
        path[first[k] : first[k + 1]] = viterbi(s[first[k] : first[k + 1]], penalty)
    order = order[FEW:]
    if not len(order):
        return path
    begin, size = first[order], first[order + 1] - first[order]
    longer = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left").tolist()  # blocks of more than t rows come first
    own = np.arange(s.shape[1], dtype=np.int32)
    here, live = s[begin], len(order)
    back = [np.zeros((0, 0), np.int32)]
    last = np.zeros(live, np.int64)
    for t in range(1, int(size[0])):
        now = longer[t]
        last[now:live] = np.argmax(here[now:live], axis=1)
        live, here = now, here[:now]
        top = np.argmax(here, axis=1)
        jump = (here[np.arange(live), top] - penalty)[:, None]
        stay = here >= jump
        back.append(np.where(stay, own, top[:, None].astype(np.int32)))
        here = np.where(stay, here, jump) + s[begin[:live] + t]
    last[:live] = np.argmax(here, axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        now = longer[t]
        path[begin[:now] + t] = last[:now]
        if t:
            last[:now] = back[t][np.arange(now), last[:now]]
    return path


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = MAX_DOCS) -> Model:
    """Fit on about max_docs labelled rows of each language, those with the least key hash."""
    labelled = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, TABLE)), np.zeros((0, OTHER + 1)))
    share = F.create_map(*(x for g in langs for x in (F.lit(g), F.lit(min(1.0, max_docs / sizes[g])))))[F.col("l")]
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(place <= share).select("l", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, "t"):
            names = np.array(batch.column(0).to_pylist(), object)
            found = Words(*utf8(batch.column(1)))
            buckets, start = found.trigrams()
            scripts, sizes_ = found.scripts(), np.diff(start)
            for g in set(names.tolist()):
                which = found.which[np.repeat(names == g, np.diff(found.first))]
                each = np.repeat(np.bincount(which, minlength=len(sizes_)), sizes_)
                c = counts.setdefault(g, np.zeros(TABLE + OTHER + 1, np.int64))
                c[:TABLE] += np.bincount(buckets, weights=each, minlength=TABLE).astype(np.int64)
                letters = scripts >= 0
                c[TABLE:] += np.bincount(scripts[letters], weights=each[letters], minlength=OTHER + 1).astype(np.int64)
        for g, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(some), pa.string()), pa.array(some), pa.array(c[some])], ["l", "b", "n"])

    rows = sample.mapInArrow(thrifty(run), "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(langs), TABLE + OTHER + 1))
    at = {g: k for k, g in enumerate(langs)}
    for g, b, n in rows:
        counts[at[g], b] = n
    return Model(langs, counts[:, :TABLE], counts[:, TABLE:])


FOUND = "struct<lang_pred:string,score:double,lang_spans:array<struct<lang:string,begin:int,end:int,n_words:int>>>"


def identify(docs: DataFrame, model: Model, *, text: str = "text", into: str = "language", penalty: float = PENALTY) -> DataFrame:
    """docs with a column `into` of (lang_pred, score, lang_spans); only texts go to Python.

    A span has a language, its code points (end exclusive) and its words; score is
    the share of the text's letters and marks in spans of lang_pred.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces(columns):
            yield spans_of(shared.value, texts, penalty)

    return docs.withColumn(into, arrow_column(run, FOUND)(F.col(text)))


def spans_of(model: Model, column: pa.Array, penalty: float) -> pa.Array:
    """FOUND of every text of a column."""
    n = len(column)
    data, at = utf8(column)
    words = Words(data, at)
    first = words.first if model.langs else np.zeros(n + 1, np.int64)
    size = words.size[: first[-1]]
    of = np.repeat(np.arange(n), np.diff(first))
    path = np.zeros(0, np.int64)
    if len(of):
        s = model.scores(words)[words.which]
        path = label(s, first, penalty)
        known = np.zeros(n, bool)
        known[of[s.any(axis=1)]] = True
        path[~known[of]] = model.default
    names = pa.array(model.langs or [""], pa.string())
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(path))[: len(head)] - 1
    begin = words.begin[: len(path)] - words.origin[of]
    spans = pa.StructArray.from_arrays(
        [names.take(pa.array(path[head])), pa.array(begin[head].astype(np.int32)), pa.array((begin[tail] + size[tail]).astype(np.int32)), pa.array((tail - head + 1).astype(np.int32))],
        ["lang", "begin", "end", "n_words"],
    )
    ends = np.searchsorted(head, first).astype(np.int32)
    letters = np.bincount(of * max(1, len(model.langs)) + path, weights=size, minlength=n * max(1, len(model.langs))).reshape(n, -1)
    best = np.argmax(letters, axis=1) if n else np.zeros(0, np.int64)
    total = letters.sum(axis=1)
    score = np.divide(letters[np.arange(n), best], total, out=np.zeros(n), where=total > 0)
    lang = names.take(pa.array(best, mask=total == 0)).fill_null("und")
    return pa.StructArray.from_arrays([lang, pa.array(score), pa.ListArray.from_arrays(pa.array(ends), spans)], ["lang_pred", "score", "lang_spans"])


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    spans = F.transform("language.lang_spans", lambda s: F.concat_ws(":", s["lang"], s["begin"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "language.lang_pred", "language.score", F.size("language.lang_spans").cast("long").alias("n_spans"), F.array_join(spans, ",").alias("spans"))


QUERIES = {"op2_language_spans": op2_language_spans}
