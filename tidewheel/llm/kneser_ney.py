"""Operator 4: interpolated modified Kneser-Ney, counted in Spark, kept as sorted hash arrays.

Counting. Tasks count their own n-grams in numpy and send each partition one
compressed block of (ids, count); a partition is a range of hashes of the
context, so a frequent word is spread over its followers' contexts only as far
as its own count needs, and blocks of one context meet in one task as sums. The
partition writes its contexts as a sorted array of 64-bit hashes, each with the
ids of the words that follow it, sorted, and with
counts beside them (a byte each; larger ones, up to 64 bits, in a list), and passes on each n-gram without its first word, once, which
gives the continuation counts of the order below. Words become ids through the
vocabulary, which is such an array too.

Scoring. Workers map the arrays into memory (files of the shared folder; where
that is not a mounted folder, a copy of them) and look up the sorted hashes of a
slice of texts at a time. Every text is scored by every worker's own lookups:
nothing is shuffled.

A text is its words and one end. Unknown words share one probability; an unseen
context leaves the order below as it is; the lowest order is mixed with the
uniform distribution over all words, the end and the unknown. Discounts come from
counts of counts and stay within [0.1, k - 0.1] for count k, so that small
corpora have probabilities for everything.

Defined cases: null is the empty text, which is one end; rows with a null key
train; repeated rows count each; without training rows every token has the
uniform probability; other columns are not read. Words are [^\\x20\\x09-\\x0D]+
with A-Z in lower case.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_class, mapped, mix, new_path, put, slices, table, utf8, words

ORDER = 2
#: Order of the query's model.
QUERY_ORDER = 3
#: N-grams that a task counts before it sends them on.
FLUSH = 5_000_000
_SPACE = byte_class("space")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The followers of a context begin at a start, kept every so many contexts, and a small step from there.
BLOCK = 64
#: Ids: 0 unknown, 1 begin, 2 end, words from 3.
UNKNOWN, BEGIN, END, FIRST = 0, 1, 2, 3


# ---- arrays in the shared folder ------------------------------------------------


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest of 1, 2, 4 or 8 bytes that hold all of them."""
    most = int(a.max()) if len(a) else 0
    return a.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << 8 * w))


def bucket_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Range partition of uniform hashes: order is kept."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def put_small(folder: str, name: str, a: np.ndarray) -> None:
    """Numbers of a byte each; then the places and values of those of 255 and more."""
    big = np.flatnonzero(a >= 255)
    small = np.zeros(len(a) + -len(a) % 8, np.uint8)
    small[: len(a)] = np.minimum(a, 255)
    put(folder, name, np.concatenate([small, np.stack([big, a[big]]).astype("<u8").view(np.uint8).reshape(-1)]))


def get_small(folder: str, name: str, size: int, at: np.ndarray) -> np.ndarray:
    raw = mapped(folder, name, "u1")
    out = raw[at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        places, values = raw[size + -size % 8 :].view("<u8").reshape(2, -1)
        out[big] = values[np.searchsorted(places, at[big].astype(np.uint64))]
    return out


@dataclass
class Arrays:
    """One sorted hash array a bucket, with value arrays beside it and, of contexts, the words that follow."""

    folder: str
    names: list[str | None]

    def find(self, bucket: np.ndarray, keys: np.ndarray, *values: str) -> list[np.ndarray]:
        """The place of each key in its bucket (-1 if absent), then its values (0 if absent)."""
        out = [np.full(len(keys), -1, np.int64), *(np.zeros(len(keys), np.int64) for _ in values)]
        order = np.lexsort((keys, bucket))
        b, k = bucket[order], keys[order]
        edges = np.searchsorted(b, np.arange(len(self.names) + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            name = self.names[p]
            if name is None:
                continue
            lo, hi = edges[p], edges[p + 1]
            have = mapped(self.folder, f"{name}.hash", "<u8")
            if not len(have):
                continue
            at = np.minimum(np.searchsorted(have, k[lo:hi]), len(have) - 1)
            hit = have[at] == k[lo:hi]
            to, at = order[lo:hi][hit], at[hit]
            out[0][to] = at
            for v, name_of in enumerate(values):
                out[v + 1][to] = get_small(self.folder, f"{name}.{name_of}", len(have), at)
        return out

    def follow(self, contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Five rows: the count of each id after its context, then the context's total, n1, n2 and n3; 0 if absent."""
        out = np.zeros((5, len(contexts)), np.int64)
        order = np.argsort(contexts)
        keys, ids = contexts[order], ids[order]
        edges = np.searchsorted(bucket_of(keys, len(self.names)), np.arange(len(self.names) + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            name = self.names[p]
            if name is None:
                continue
            lo, hi = edges[p], edges[p + 1]
            have = mapped(self.folder, f"{name}.hash", "<u8")
            if not len(have):
                continue
            at = np.minimum(np.searchsorted(have, keys[lo:hi]), len(have) - 1)
            hit = have[at] == keys[lo:hi]
            to, at, want = order[lo:hi][hit], at[hit], ids[lo:hi][hit]
            for row, value in enumerate(("total", "n1", "n2"), 1):
                out[row][to] = get_small(self.folder, f"{name}.{value}", len(have), at)
            starts = mapped(self.folder, f"{name}.start", "<u8")
            left, end = (starts[i // BLOCK].astype(np.int64) + get_small(self.folder, f"{name}.step", len(have) + 1, i) for i in (at, at + 1))
            out[4][to] = end - left - out[2][to] - out[3][to]
            followers = mapped(self.folder, f"{name}.word", "<u4")
            right, live = end.copy(), np.arange(len(at))
            while len(live):  # every search halves its own context's followers
                middle = (left[live] + right[live]) >> 1
                less = followers[middle] < want[live]
                left[live] = np.where(less, middle + 1, left[live])
                right[live] = np.where(less, right[live], middle)
                live = live[left[live] < right[live]]
            found = np.flatnonzero(left < end)
            found = found[followers[left[found]] == want[found]]
            out[0][to[found]] = get_small(self.folder, f"{name}.count", len(followers), left[found])
        return out


# ---- blocks between tasks -------------------------------------------------------


def shuffle_bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows sorted by columns, with counts; each column's bytes lie by significance; all but the last are steps, small among rows of one word."""
    steps = [np.diff(c, prepend=c.dtype.type(0)) for c in (columns[:-1] or columns)]
    body = [shuffle_bytes(c) for c in [*steps, *columns[len(steps) :], narrow(counts)]]
    return np.array([len(counts), len(columns)], "<u4").tobytes() + zstandard.compress(b"".join(body), 1)


def unpack(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    body = np.frombuffer(zstandard.decompress(data[8:]), np.uint8)
    columns = [np.ascontiguousarray(x.T).view("<u4").reshape(-1) for x in body[: 4 * m * n].reshape(m, 4, n)]
    for k in range(max(m - 1, 1)):
        columns[k] = np.cumsum(columns[k], dtype=np.uint32)
    rest = body[4 * m * n :].reshape(-1, n)
    return columns, np.ascontiguousarray(rest.T).view(f"<u{len(rest)}").reshape(-1)


def sum_rows(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows summed, sorted by columns."""
    if not len(counts):
        return columns, counts.astype(np.int64)
    if len(columns) <= 2:
        key = columns[0].astype(np.uint64)
        if len(columns) == 2:
            key = (key << np.uint64(32)) | columns[1]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(counts), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    at = np.flatnonzero(new)
    return [c[order][at] for c in columns], np.add.reduceat(counts[order].astype(np.int64), at)


def hash_ids(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = mix(h * _STEP + c.astype(np.uint64))
    return h


def context_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Of all words but the last; a single word is placed by itself."""
    return hash_ids(columns[:-1] if len(columns) > 1 else columns)


def split(columns: list[np.ndarray], counts: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    bucket = bucket_of(context_hash(columns), parts)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[p] : edges[p + 1]]
        yield p, pack([c[at] for c in columns], counts[at])


# ---- the model ------------------------------------------------------------------


@dataclass
class Level:
    """Arrays of one order and what is known of all of it."""

    arrays: Arrays
    counts_of_counts: list[int]
    total: int
    kinds_by_count: list[int]

    @property
    def discounts(self) -> np.ndarray:
        """By count 0, 1, 2 and 3 or more."""
        n = [0, *self.counts_of_counts]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2 for k in (1, 2, 3)]
        return np.array([0.0, *(min(max(x, 0.1), k - 0.1) for k, x in zip((1, 2, 3), d, strict=True))])


@dataclass
class Model:
    order: int
    parts: int
    vocabulary: Arrays
    offsets: np.ndarray
    docs: int
    tokens: int
    types: int
    levels: dict[int, Level]

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, training counts) of word hashes."""
        unique, back = np.unique(h, return_inverse=True)
        bucket = bucket_of(unique, self.parts)
        place, counts = self.vocabulary.find(bucket, unique, "count")
        ids = np.where(place >= 0, place + self.offsets[bucket] + FIRST, UNKNOWN).astype(np.uint32)
        return ids[back], counts[back]

    def probabilities(self, grams: list[np.ndarray]) -> np.ndarray:
        """Of the last of `order` columns of ids, given the ones before; columns may begin with BEGIN."""
        seen = self.levels[1]
        d = seen.discounts
        bucket = bucket_of(context_hash(grams[-1:]), self.parts)
        _, c = seen.arrays.find(bucket, hash_ids(grams[-1:]), "count")
        words_ = self.types - (1 if self.docs else 0)
        uniform = 1.0 / (words_ + 2)  # the end and the unknown
        if seen.total:
            spare = float(d[1:] @ seen.kinds_by_count) / seen.total
            p = np.maximum(c - d[np.minimum(c, 3)], 0) / seen.total + spare * uniform
        else:
            p = np.full(len(c), uniform)
        for n in range(2, self.order + 1):
            level, columns = self.levels[n], grams[-n:]
            d = level.discounts
            c, total, n1, n2, n3 = level.arrays.follow(context_hash(columns), columns[-1])
            known = total > 0
            size = np.where(known, total, 1)
            higher = np.maximum(c - d[np.minimum(c, 3)], 0) / size + (d[1] * n1 + d[2] * n2 + d[3] * n3) / size * p
            p = np.where(known, higher, p)
        return p


STATS = "p int, block binary, level int, file string, entries long, total long, k1 long, k2 long, k3 long, k4 long, k3p long"


def _stats_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.binary(), pa.int32(), pa.string(), *[pa.int64()] * 7]
    names = [x.strip().split(" ")[0] for x in STATS.split(",")]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def train(docs: DataFrame, *, text: str = "text", order: int = ORDER, parts: int | None = None) -> Model:
    """Count a model of all rows of docs; its arrays lie in a new part of the shared folder."""
    spark = docs.sparkSession
    folder = new_path(spark, "kneser-ney")
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(F.col(text).alias("__text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = n_docs = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                order_ = np.argsort(h)
                h, c = h[order_], c[order_]
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                h, c = h[at], np.add.reduceat(c, at)
                edges = np.searchsorted(bucket_of(h, parts), np.arange(parts + 1))
                some = np.flatnonzero(np.diff(edges)).tolist()
                blocks = [zstandard.compress(shuffle_bytes(h[edges[p] : edges[p + 1]]) + shuffle_bytes(c[edges[p] : edges[p + 1]].astype("<u8")), 1) for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blocks, pa.binary()), pa.array([0] * len(some), pa.int64())], ["p", "block", "docs"])

        for batch in slices(batches, "__text", 2 << 20):
            data, at = utf8(batch.column(0))
            w, _ = words(data, at, _SPACE)
            n_docs += batch.num_rows
            held.append(np.unique(w, return_counts=True))
            size += len(held[-1][0])
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([None], pa.binary()), pa.array([n_docs], pa.int64())], ["p", "block", "docs"])

    def keep_words(group: pa.Table) -> pa.Table:
        p = group.column("p")[0].as_py()
        h, c = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for block in group.column("block").to_pylist():
            if block is not None:
                raw = np.frombuffer(zstandard.decompress(block), np.uint8).reshape(2, 8, -1)
                both = [np.ascontiguousarray(x.T).view("<u8").reshape(-1) for x in raw]
                h.append(both[0])
                c.append(both[1])
        keys, back = np.unique(np.concatenate(h), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate(c), minlength=len(keys)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        name = f"words-{p:06d}-{uuid.uuid4().hex}"
        put(folder, f"{name}.hash", keys)
        put_small(folder, f"{name}.count", counts)
        n_docs = sum(x for x in group.column("docs").to_pylist())
        return _stats_table([(p, None, 0, name, len(keys), int(counts.sum()), n_docs, 0, 0, 0, 0)])

    names: list[str | None] = [None] * parts
    sizes, tokens, n_docs = np.zeros(parts, np.int64), 0, 0
    for r in source.mapInArrow(count_words, "p int, block binary, docs long").groupBy("p").applyInArrow(keep_words, STATS).select("p", "file", "entries", "total", "k1").collect():  # one row a partition
        names[r.p], sizes[r.p] = r.file, r.entries
        tokens += r.total
        n_docs += r.k1
    if sizes.sum() + FIRST > 1 << 32:
        raise ValueError(f"{sizes.sum()} distinct words: ids are of 32 bits")
    vocabulary = Arrays(folder, names)
    offsets = np.cumsum(sizes) - sizes
    model = Model(order, parts, vocabulary, offsets, n_docs, tokens + n_docs, int(sizes.sum()) + (1 if n_docs else 0), {})
    shared = spark.sparkContext.broadcast(model)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                columns, counts = sum_rows([np.concatenate([x[0][k] for x in held]) for k in range(order)], np.concatenate([x[1] for x in held]))
                blocks = list(split(columns, counts, parts))
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary())], ["p", "block"])

        for batch in slices(batches, "__text", 2 << 20):
            _, _, grams = sequences(shared.value, batch.column(0), order)
            columns, counts = sum_rows(grams, np.ones(len(grams[0]), np.int64))
            held.append((columns, counts))
            size += len(counts)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        yield from flush()

    blocks = source.mapInArrow(count_grams, "p int, block binary")
    above = None
    for n in range(order, 0, -1):
        path = new_path(spark, f"level-{n}")
        blocks.groupBy("p").applyInArrow(_keep_grams(folder, n, parts), STATS).write.parquet(path)
        stored = spark.read.schema(STATS).parquet(path)
        model.levels[n] = _level(folder, stored, n, parts)
        blocks = stored.filter("block is not null").select("p", "block")
        if above:  # counted: its blocks are not read again
            _remove(spark, above)
        above = path
    return model


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _keep_grams(folder: str, n: int, parts: int):
    def keep(group: pa.Table) -> pa.Table:
        p = group.column("p")[0].as_py()
        got = [unpack(b) for b in group.column("block").to_pylist()]
        columns, counts = sum_rows([np.concatenate([x[0][k] for x in got]) for k in range(n)], np.concatenate([x[1] for x in got]))
        name = f"level{n}-{p:06d}-{uuid.uuid4().hex}"
        kinds = np.bincount(np.minimum(counts, 5), minlength=6)
        rows: list[tuple] = [(p, None, n, name, len(counts), int(counts.sum()), *kinds[1:5].tolist(), int(kinds[3:].sum()))]
        if n > 1:
            new = np.zeros(len(counts), bool)
            new[:1] = True
            for c in columns[:-1]:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            ctx = context_hash([c[at] for c in columns])
            order = np.argsort(ctx)
            first = np.concatenate([[0], np.cumsum(np.diff(np.append(at, len(counts)))[order])])
            put(folder, f"{name}.hash", ctx[order])
            put_small(folder, f"{name}.total", np.add.reduceat(counts, at)[order])
            for k in (1, 2):
                put_small(folder, f"{name}.n{k}", np.add.reduceat((counts == k).astype(np.int64), at)[order])
            put(folder, f"{name}.start", first[::BLOCK].astype("<u8"))
            put_small(folder, f"{name}.step", first - first[np.arange(len(first)) // BLOCK * BLOCK])
            row = np.repeat(at[order] - first[:-1], np.diff(first)) + np.arange(len(counts))
            put(folder, f"{name}.word", columns[-1][row].astype("<u4"))
            put_small(folder, f"{name}.count", counts[row])
            lower, seen = sum_rows(columns[1:], np.ones(len(counts), np.int64))
            rows += [(to, block, n, None, 0, 0, 0, 0, 0, 0, 0) for to, block in split(lower, seen, parts)]
        else:
            h = hash_ids(columns)
            order = np.argsort(h)
            put(folder, f"{name}.hash", h[order])
            put_small(folder, f"{name}.count", counts[order])
        return _stats_table(rows)

    return keep


def _level(folder: str, stored: DataFrame, n: int, parts: int) -> Level:
    names: list[str | None] = [None] * parts
    kinds, total, high = np.zeros(4, np.int64), 0, 0
    for r in stored.filter("file is not null").drop("block").collect():  # one row a partition
        names[r.p] = r.file
        kinds += np.array([r.k1, r.k2, r.k3, r.k4])
        total += r.total
        high += r.k3p
    return Level(Arrays(folder, names), kinds.tolist(), total, [int(kinds[0]), int(kinds[1]), high])


def sequences(model: Model, column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(first token of each text, training count of each token, n-grams as columns of ids)."""
    data, at = utf8(column)
    w, first = words(data, at, _SPACE)
    ids, counts = model.ids(w)
    docs = len(first) - 1
    size = np.diff(first) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    where = np.arange(len(w)) + np.repeat(np.arange(docs), np.diff(first))
    tokens = np.full(start[-1], END, np.uint32)
    tokens[where] = ids
    of = np.full(start[-1], model.docs, np.int64)
    of[where] = counts
    place = np.arange(start[-1]) - np.repeat(start[:-1], size)
    columns = []
    for back in range(order - 1, 0, -1):
        previous = np.roll(tokens, back)
        previous[place < back] = BEGIN
        columns.append(previous)
    return start, of, [*columns, tokens]


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens, n_known, base_score, score and perplexity of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) + ", n_tokens long, n_known long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "__text", 2 << 20):
            start, counts, grams = sequences(m, batch.column(len(keep)), m.order)
            sums = lambda x: np.add.reduceat(x, start[:-1])  # noqa: E731  every text has a token
            base = sums(np.log10((counts + 1) / (m.tokens + m.types + 1)))
            found = sums(np.log10(m.probabilities(grams)))
            n = np.diff(start)
            out = [n, sums((counts > 0).astype(np.int64)), base, found, np.power(10.0, -found / n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x) for x in out)], [*keep, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out()), order=QUERY_ORDER)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


QUERIES = {"op4_kneser_ney": op4_kneser_ney}
