"""Operator 3: benchmark decontamination by suffix arrays over the training texts.

Each slice of the training documents is a shard. Its words become ids of the
benchmark's vocabulary (0 for any other word), and the suffixes that can match
are sorted into a suffix array: those whose first words occur, in this order,
somewhere in the benchmark; any other suffix has no match of window length. The
sort goes as deep as a window. Every benchmark suffix is then binary-searched in
the shard, word by word, all suffixes at a time; what is left after a window's
words is the range of its verbatim occurrences. Neighbouring windows on one
diagonal join into the longest matches.

The benchmark is the query set. Tasks build it in blocks of about BLOCK_BYTES of
text and write each block's arrays to the shared folder; workers map them, and a
shard meets one block at a time. The driver sees one row a block and nothing is
broadcast. Documents are never shuffled.

Defined cases: null and word-free texts have no words and no matches; an item of
fewer words than a window is one window, one without words never matches; equal
texts are each reported under their item_id, repeated rows of an item once; null or repeated doc_id values are carried through, one
result per input row; a null item_id is ignored; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, byte_class, mapped, mix, new_path, pieces, put, spare, table, utf8, words

WINDOW = 13
BLOCK_BYTES = 4 << 20
_ALNUM = byte_class("alnum")
_FILTER_BITS = 22


class TestSuffixes:
    """A block of items: vocabulary, ids, and the windows with the items that hold them."""

    __test__ = False
    KINDS = {"vocabulary": "<u8", "grid": "<i4", "sizes": "<i8", "item": "<i8", "offset": "<i8", "order": "<i8", "holders": "<i8", "bitmap": "?", "names": "u1", "name_at": "<i8"}

    def __init__(self, items: list[str], texts: list[str], window: int):
        encoded = [x.encode() for x in items]
        self.names = np.frombuffer(b"".join(encoded), np.uint8)
        self.name_at = np.cumsum([0, *map(len, encoded)])
        data, at = utf8(pa.array(texts, pa.string()))
        w, first = words(data, at, _ALNUM)
        self.vocabulary = np.unique(w)
        count = np.diff(first)
        ids = (np.searchsorted(self.vocabulary, w) + 1).astype(np.int64)
        windows = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
        item = np.repeat(np.arange(len(texts)), windows)
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(windows, out=starts[1:])
        begin = first[item] + np.arange(starts[-1]) - starts[item]
        self.item, self.offset = item, begin - first[item]
        self.length = np.minimum(count[item], window).astype(np.int64)
        self.depth = int(self.length.max()) if len(item) else 0
        padded = np.concatenate([ids, np.zeros(window, np.int64)])
        grid = padded[begin[:, None] + np.arange(window)] if len(item) else np.zeros((0, window), np.int64)
        grid[np.arange(window) >= self.length[:, None]] = 0
        #: distinct windows in sorted order; which of them each (item, offset) is
        self.grid, self.window_of = np.unique(grid, axis=0, return_inverse=True) if len(item) else (grid, np.zeros(0, np.int64))
        self.window_of = self.window_of.reshape(-1)
        self.order = np.argsort(self.window_of, kind="stable")
        self.holders = np.searchsorted(self.window_of[self.order], np.arange(len(self.grid) + 1))
        self.sizes = (self.grid > 0).sum(axis=1)
        self.grid = self.grid.astype(np.int32)
        #: the first words that every candidate suffix must share with some window
        self.lead = int(min(3, self.sizes.min())) if len(self.grid) else 0
        self.bitmap = np.zeros(1 << _FILTER_BITS, bool)
        if self.lead:
            self.bitmap[lead_hash([self.grid[:, k] for k in range(self.lead)])] = True

    def save(self, folder: str, name: str) -> None:
        for part, kind in self.KINDS.items():
            put(folder, f"{name}.{part}", getattr(self, part).astype(kind))

    @classmethod
    def load(cls, folder: str, name: str, window: int, depth: int, lead: int) -> TestSuffixes:
        """A saved block; its arrays are mapped files."""
        self = cls.__new__(cls)
        for part, kind in cls.KINDS.items():
            setattr(self, part, np.asarray(mapped(folder, f"{name}.{part}", kind)))
        self.grid = self.grid.reshape(-1, window)
        self.depth, self.lead = depth, lead
        return self

    def item_name(self, k: int) -> str:
        return self.names[self.name_at[k] : self.name_at[k + 1]].tobytes().decode()


def lead_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
    return (mix(h) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def suffix_array(ids: np.ndarray, candidates: np.ndarray, depth: int) -> np.ndarray:
    """Candidate positions sorted by the `depth` ids that begin there; ids ends with `depth` zeros."""
    pair = lambda p: (ids[p] << np.int64(31)) | ids[p + 1]
    key = pair(candidates)
    order = np.argsort(key, kind="stable")
    out, key = candidates[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
    for at in range(2, depth, 2):
        same = np.zeros(len(out), bool)
        same[1:] = group[1:] == group[:-1]
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        key = pair(np.minimum(out[tied] + at, len(ids) - 2))
        order = np.lexsort((key, group[tied]))
        out[tied] = out[tied][order]
        key = key[order]
        parted = np.zeros(len(out), np.int64)
        new = (key[1:] != key[:-1]) & same[tied[1:]]
        parted[tied[1:][new]] = 1
        change = np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])
        group = np.cumsum(change + parted)
    return out


def search(ids: np.ndarray, array: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, low, high) of the windows that occur: their range of the suffix array."""
    query = np.arange(len(tests.grid))
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(array), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(tests.depth):
        over = tests.sizes[query] == k
        if over.any():
            done.append((query[over], low[over], high[over]))
            query, low, high = query[~over], low[~over], high[~over]
        if not len(query):
            break
        want = tests.grid[query, k]
        low, high = bound(ids, array, low, high, k, want, False), bound(ids, array, low, high, k, want, True)
        alive = low < high
        query, low, high = query[alive], low[alive], high[alive]
    done.append((query, low, high))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))  # type: ignore[return-value]


def bound(ids: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, want: np.ndarray, upper: bool) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        seen = ids[array[np.minimum(mid, len(array) - 1)] + k]
        right = open_ & ((seen <= want) if upper else (seen < want))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)


def match_shard(w: np.ndarray, first: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of the shard, word offset in the shard, distinct window) of every occurrence."""
    none = np.zeros(0, np.int64)
    if not len(w) or not len(tests.grid):
        return none, none, none
    place = np.minimum(np.searchsorted(tests.vocabulary, w), len(tests.vocabulary) - 1)
    known = np.where(tests.vocabulary[place] == w, place + 1, 0)
    docs = len(first) - 1
    # a zero after each document ends its suffixes
    at = np.arange(len(w)) + np.repeat(np.arange(docs), np.diff(first))
    ids = np.zeros(len(w) + docs + tests.depth + 2, np.int64)
    ids[at] = known
    n = len(ids) - tests.depth - 2
    lead = [ids[k : n + k] for k in range(tests.lead)]
    whole = lead[0] > 0
    for column in lead[1:]:
        whole &= column > 0
    candidates = np.flatnonzero(whole)
    candidates = candidates[tests.bitmap[lead_hash([c[candidates] for c in lead])]]
    if not len(candidates):
        return none, none, none
    array = suffix_array(ids, candidates, tests.depth)
    window, low, high = search(ids, array, tests)
    many = high - low
    total = int(many.sum())
    ends = np.cumsum(many)
    where = array[np.repeat(low - (ends - many), many) + np.arange(total)]
    begin = first[:-1] + np.arange(docs)
    doc = np.searchsorted(begin, where, "right") - 1
    return doc, where - doc, np.repeat(window, many)


def blocks_of(benchmark: DataFrame, window: int, item: str, text: str) -> tuple[str, list[tuple]]:
    """(folder, [(name, depth, lead)]): the benchmark's blocks, built and written by tasks.

    A block is a hash bucket of distinct items, so no bucket is hot; a retried
    task writes under a new name, and only names that a task returned are read.
    """
    folder = new_path(benchmark.sparkSession, "benchmark")
    items = benchmark.filter(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("item", "ascending"), ("text", "ascending")])
        block, name = TestSuffixes(rows["item"].to_pylist(), rows["text"].to_pylist(), window), uuid.uuid4().hex
        block.save(folder, name)
        return pa.table({"name": [name], "depth": pa.array([block.depth], pa.int32()), "lead": pa.array([block.lead], pa.int32())})

    parts = items.distinct().withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    made = parts.groupBy("block").applyInArrow(build, "name string, depth int, lead int")
    return folder, [tuple(r) for r in made.collect()]


RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,matches:array<struct<item:string,doc_word:int,item_word:int,n_words:int>>>"


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", into: str = "verbatim", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with a column `into`: a text's words, the words hit, the items, and the longest matches.

    matches: item, first word in the document and in the item, and how many words agree.
    Only texts go to Python.
    """
    folder, blocks = blocks_of(benchmark, window, item, item_text)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces(columns):
            yield found_in(texts, (TestSuffixes.load(folder, name, window, depth, lead) for name, depth, lead in blocks))

    return docs.withColumn(into, arrow_column(run, RESULT)(F.col(text)))


def found_in(column: pa.Array, blocks: Iterable[TestSuffixes]) -> pa.Array:
    """RESULT of every text of a shard."""
    data, at = utf8(column)
    w, first = words(data, at, _ALNUM)
    delta = np.zeros(len(w) + 1, np.int64)
    items: dict[int, set[str]] = {}
    matches: dict[int, list[dict]] = {}
    for tests in blocks:
        doc, where, window_id = match_shard(w, first, tests)
        if len(doc):
            np.add.at(delta, where, 1)
            np.add.at(delta, where + tests.sizes[window_id], -1)
            collect(tests, doc, where - first[doc], window_id, items, matches)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(delta)[:-1] > 0)])
    arrow = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))
    n = len(column)
    return pa.StructArray.from_arrays(
        [
            pa.array(np.diff(first), pa.int64()),
            pa.array(hit[first[1:]] - hit[first[:-1]], pa.int64()),
            pa.array([sorted(items.get(k, ())) for k in range(n)], pa.list_(pa.string())),
            pa.array([matches.get(k, []) for k in range(n)], arrow),
        ],
        ["n_words", "n_hit", "items", "matches"],
    )


def collect(tests: TestSuffixes, doc: np.ndarray, word: np.ndarray, window_id: np.ndarray, items: dict, matches: dict) -> None:
    """Add a shard's occurrences: the items of each document and its longest matches."""
    many = tests.holders[window_id + 1] - tests.holders[window_id]
    total, ends = int(many.sum()), np.cumsum(many)
    holder = tests.order[np.repeat(tests.holders[window_id] - (ends - many), many) + np.arange(total)]
    doc, word, size = np.repeat(doc, many), np.repeat(word, many), np.repeat(tests.sizes[window_id], many)
    item, offset = tests.item[holder], tests.offset[holder]
    order = np.lexsort((word, word - offset, item, doc))
    doc, word, size, item, offset = (x[order] for x in (doc, word, size, item, offset))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] - offset[1:] != word[:-1] - offset[:-1]) | (word[1:] > word[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc)) - 1
    for d, i, a, o, n in zip(doc[begin].tolist(), item[begin].tolist(), word[begin].tolist(), offset[begin].tolist(), (word[last] + size[last] - word[begin]).tolist(), strict=True):
        name = tests.item_name(i)
        items.setdefault(d, set()).add(name)
        matches.setdefault(d, []).append({"item": name, "doc_word": a, "item_word": o, "n_words": n})


def contaminated(found: str = "verbatim"):
    """The contract's rule: a twentieth of the words or more lies in benchmark windows."""
    hit, n = F.col(f"{found}.n_hit"), F.col(f"{found}.n_words")
    return (hit > 0) & (F.lit(20) * hit >= n)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; rows keep all their columns."""
    name = spare(docs, "verbatim")
    return verbatim_matches(docs, benchmark, into=name).filter(~contaminated(name)).drop(name)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verbatim_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "verbatim.n_words",
        "verbatim.n_hit",
        F.size("verbatim.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("verbatim.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def _oracle() -> str:
    split = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {split("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {split("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
q AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS s
      FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM q),
lead AS (SELECT DISTINCT n, split_part(s, ' ', 1) AS w1 FROM q),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT DISTINCT p.doc_id, p.i, l.n, array_to_string(list_slice(p.w, p.i, p.i + l.n - 1), ' ') AS s
      FROM p JOIN lead l ON l.w1 = p.w[p.i] WHERE p.i + l.n - 1 <= len(p.w)),
m AS (SELECT h.doc_id, h.i, h.n, q.item FROM h JOIN q ON q.s = h.s AND q.n = h.n),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) AS r(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE = {"op3_decontaminate": _oracle()}
