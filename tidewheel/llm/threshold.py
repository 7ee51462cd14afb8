"""Operator 12: ranked lexical search by Fagin's threshold algorithm.

A stated set of queries is ranked against all documents. Whole texts are read
once and leave a forward index: each document's length and its counts of the
queries' terms, written to the shared folder. Corpus counts (documents, terms,
documents of each query term) are Spark aggregates of it.

Then each task takes its documents in shards of a bounded number of postings,
gives every posting its impact and sorts each term's list by it. A query goes
down its lists round-robin; documents not yet seen are looked up in the forward
index, which gives their whole score; the threshold is the score of a document
with the impacts just reached. The query stops when the threshold falls strictly
below its kth score, so equal scores are all seen. The kth score is kept from
shard to shard of a task, and only k rows a query leave it; ranking those is the
last step. The best k of all documents are among the best k of each task's.

Queries are handled in blocks of about QUERY_BYTES of text, each with a pass of
its own; a block is what the driver and every task hold.

Defined cases: null, empty and termless texts have no terms, are not counted and
never found; a query without known terms has no rows; equal scores go by key,
null keys last; repeated documents are found each for itself, repeated or null
query keys are queries of their own; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_class, materialise, offsets_of, slices, table, thrifty, utf8, word_places

TOP = 10
QUERY_BYTES = 4 << 20
SHARD_POSTINGS = 4 << 20
#: Rounds that are taken at once; the first is short, as good lists end early.
ROUNDS = (16, 1024)
_ALNUM = byte_class("alnum")


def folded(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


class Vocabulary:
    """The distinct terms of a block of queries; words are found by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        data, at = utf8(pa.array(terms, pa.string()))
        h, _, begin, stop = word_places(data, at, _ALNUM)
        self.order = np.argsort(h)
        self.hashes, self.begin, self.size = h[self.order], begin[self.order], (stop - begin)[self.order]
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, data: np.ndarray, h: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words that are terms, their terms)."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        word = np.flatnonzero((self.hashes[rank] == h) & (self.size[rank] == stop - begin))
        rank = rank[word]
        padded = np.concatenate([folded(data), np.zeros(8, np.uint8)])
        theirs = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        ours = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        same, open_, done = np.ones(len(word), bool), np.arange(len(word)), 0
        while len(open_):
            left = self.size[rank[open_]] - done
            differ = theirs[begin[word[open_]] + done] ^ ours[self.begin[rank[open_]] + done]
            spare_bits = (8 * np.maximum(8 - left, 0)).astype(np.uint64)
            same[open_[(differ << spare_bits) != 0]] = False
            open_, done = open_[left > 8], done + 8
        return word[same], self.order[rank[same]]


def terms_of(text: str | None) -> list[str]:
    data, at = utf8(pa.array([text or ""], pa.string()))
    _, _, begin, stop = word_places(data, at, _ALNUM)
    raw = folded(data).tobytes()
    return [raw[a:b].decode() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]


def forward_index(docs: DataFrame, terms: list[str], *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key long, n, terms, tfs) of every document with a term: n counts all its terms, the arrays those of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(terms)
        for batch in slices(batches, "t"):
            data, at = utf8(batch.column(1))
            h, first, begin, stop = word_places(data, at, _ALNUM)
            word, term = known.find(data, h, begin, stop)
            doc = np.searchsorted(first, word, "right") - 1
            pair, tf = np.unique(doc * max(1, len(known)) + term, return_counts=True)
            doc = pair // max(1, len(known))
            some = np.diff(first) > 0
            ends = np.searchsorted(doc, np.append(np.flatnonzero(some), len(first)), "left").astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.array(np.diff(first)[some]), listed(pair % max(1, len(known))), listed(tf)], ["key", "n", "terms", "tfs"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t")).mapInArrow(thrifty(run), "key long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Some documents' forward index and the impact-sorted list of every term among them."""

    def __init__(self, key: np.ndarray, null: np.ndarray, start: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.key, self.null, self.start, self.term, self.impact = key, null, start, term, impact
        doc = np.repeat(np.arange(len(key)), np.diff(start))
        order = np.lexsort((-impact, term))
        self.listed, self.falling = doc[order], impact[order]
        self.lists = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.seen = np.zeros(len(key), bool)
        self.weight = np.zeros(n_terms, np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Random access: the whole score of each document, each of which has a posting, under the weights set."""
        size = self.start[docs + 1] - self.start[docs]
        upto = np.cumsum(size) - size
        place = np.repeat(self.start[docs] - upto, size) + np.arange(size.sum())
        return np.add.reduceat(self.weight[self.term[place]] * self.impact[place], upto)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Puts the best documents into `best`; returns how many were looked up."""
        self.weight[terms] = weights
        self.seen[:] = False
        head, end = self.lists[terms], self.lists[terms + 1]
        depth, step, looked = 0, ROUNDS[0], 0
        while True:
            size = np.clip(end - head - depth, 0, step)
            if not size.any():
                break
            upto = np.cumsum(size) - size
            met = self.listed[np.repeat(head + depth - upto, size) + np.arange(size.sum())]
            met = np.unique(met[~self.seen[met]])
            self.seen[met] = True
            if len(met):
                looked += len(met)
                best.add(self.scores(met), self.null[met], self.key[met])
            depth, step = depth + step, min(2 * step, ROUNDS[1])
            reached = np.where(head + depth <= end, self.falling[np.minimum(head + depth, end) - 1], 0)
            if best.full and int((weights * np.where(head < end, reached, 0)).sum()) < best.least:
                break
        self.weight[terms] = 0
        return looked


class Best:
    """The k best (score, null, key) so far, equal scores by key."""

    def __init__(self, k: int):
        self.k, self.full, self.least = k, False, 0
        self.score, self.null, self.key = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, key: np.ndarray) -> None:
        use = score >= max(1, self.least)
        score, null, key = np.concatenate([self.score, score[use]]), np.concatenate([self.null, null[use]]), np.concatenate([self.key, key[use]])
        top = np.lexsort((key, null, -score))[: self.k]
        self.score, self.null, self.key = score[top], null[top], key[top]
        self.full = len(top) == self.k
        self.least = int(self.score[-1]) if self.full else 0


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """A posting's impact from its count and its document's length; whole numbers, divisions round down."""
    m = 100 - 75 + (75 * n * n_docs) // n_all
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def shards(batches: Iterator[pa.RecordBatch], n_docs: int, n_all: int, n_terms: int, most: int) -> Iterator[Shard]:
    """The documents of a task in shards of about `most` postings."""
    held: list[tuple] = []
    postings = 0
    for batch in batches:
        at = offsets_of(batch.column(2))
        size = np.diff(at)
        some = size > 0
        n, tf = batch.column(1).to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
        key = batch.column(0)
        held.append((key.fill_null(0).to_numpy()[some], key.is_null().to_numpy(zero_copy_only=False)[some], size[some], batch.column(2).flatten().to_numpy(), impacts(tf, np.repeat(n, size), n_docs, n_all)))
        postings += len(tf)
        if postings >= most:
            yield _shard(held, n_terms)
            held, postings = [], 0
    if postings:
        yield _shard(held, n_terms)


def _shard(held: list[tuple], n_terms: int) -> Shard:
    key, null, size, term, impact = (np.concatenate(x) for x in zip(*held, strict=True))
    return Shard(key, null, np.concatenate([[0], np.cumsum(size)]), term, impact, n_terms)


def search_block(docs: DataFrame, items: list[tuple[int, Counter]], *, text: str, key: str, k: int, most: int) -> DataFrame:
    """(no, doc, score): the k best documents of each task for each of the numbered queries."""
    terms = sorted({t for _, found in items for t in found})
    place = {t: i for i, t in enumerate(terms)}
    index = materialise(forward_index(docs, terms, text=text, key=key), "forward-index")
    n_docs, n_all = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        df[r.t] = r.n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    asked = []
    for no, found in items:
        own = np.array([place[t] for t in found], np.int64)
        by = np.array(list(found.values()), np.int64) * weight[own]
        asked.append((no, own[by > 0], by[by > 0]))
    n_terms = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for shard in shards(batches, n_docs, n_all, n_terms, most):
            for (_, own, by), top in zip(asked, best, strict=True):
                if len(own):
                    shard.search(own, by, top)
        for (no, _, _), top in zip(asked, best, strict=True):
            if len(top.key):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.key), no, np.int64)), pa.array(top.key, mask=top.null), pa.array(top.score)], ["no", "doc", "score"])

    return index.mapInArrow(thrifty(run), "no long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, *, k: int = TOP, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", block_bytes: int = QUERY_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item key, rank, doc_id, score): for every row of items its k best documents with a score above 0."""
    asked = materialise(items.select(F.col(item_key).alias("item"), F.col(item_text).alias("t")).filter("t <> ''").withColumn("no", F.monotonically_increasing_id()), "queries")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / block_bytes))
    found = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("no"), F.lit(blocks)) == b).select("no", "t").collect()  # a block, as bounded above
        block = [(r.no, Counter(terms_of(r.t))) for r in sorted(rows, key=lambda r: r.no)]
        found.append(search_block(docs, [x for x in block if x[1]], text=text, key=key, k=k, most=shard_postings))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.expr("row_number() OVER (PARTITION BY no ORDER BY score DESC, doc ASC NULLS LAST)")).filter(F.col("rank") <= k)
    return ranked.join(asked.select("no", "item"), "no").select(F.col("item").alias(item_key), "rank", F.col("doc").alias("doc_id"), "score")


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

QUERIES = {"op12_threshold_search": op12_threshold_search}
ORACLE = {
    "op12_threshold_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_all FROM d WHERE len(t) > 0),
i AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
p AS (SELECT doc_id, term, n, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_all)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
}
