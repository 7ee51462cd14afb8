"""Operator 6: near-duplicates by BagMinHash and banding, verified on multisets.

A text is the multiset of its five-word shingles. BagMinHash gives it a
signature whose components of two texts agree with a probability equal to their
weighted Jaccard similarity: each shingle and weight level starts Poisson
processes over nested intervals of weights ((0,1], (1,2], (2,4], ...); points
fall on random registers at random levels, those above the shingle's weight do
not count, and each register keeps its first point. Points later than a bound
that fills all registers are never made, so the work is a few points for each
register, not for each shingle and register.

Signatures are cut into bands. Equal texts become one node first. Documents that
agree in a band meet in a bucket. Buckets are worked on by class, and no bucket's
pairs are listed beyond a bound:

* Star. Every bucket's best-connected member is compared with its others. Links
  make classes; a bucket whose members are all of one class is done, whatever its
  size, since only classes matter. The compared member leaves.
* What is left of buckets up to DIRECT members is compared pair by pair, members
  of one class never. Sizes that rule a link out spare the comparison.
* Of larger ones, members are compared with a centre v: in odd rounds the
  best-connected node of the class that most of the bucket is of (one centre for
  all buckets of that class, in the bucket or not), in even rounds a member, so
  that every bucket shrinks. 1 - similarity is a metric: whatever a member at 0.6
  or more from v links with is at 0.4 or more from v, so members at 0.6 or more
  leave, if all links between members at 0.4 or more are found. Of those members
  the symmetric difference D to v is kept. |x ^ y| = |D(x) ^ D(y)|, so a link
  needs a known part of both differences in common. Of a link between two classes
  one end is not of v's class, hence below 0.8 from v: only such ends are indexed,
  by the prefix of D that a link must touch, and all others ask with the short
  prefix that their own D leaves them. Sizes and places in D rule out most of what
  meets. Any fixed order of D is right; common differences come last, so that few
  meet by chance.
* Members below 0.6 stay for the next round, or, once at most LEFT stay, for a
  comparison pair by pair. DIRECT and LEFT change the work, not the result.

So every link inside a bucket is found, implied by its class, or ruled out. With
25 bands of 5, a pair at exactly 0.8 meets in no band with a probability of 5e-5.

Defined cases: a text of fewer than five words, but not none, is one shingle;
null and word-free texts are a class of their own each; null and repeated keys
are carried through, one result per input row; other columns are not read.
Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in lower case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_class, gram_hashes, materialise, mix, slices, spare, table, thrifty, utf8, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: What the star leaves of a bucket is compared pair by pair up to this size, and what a centre leaves up to LEFT.
DIRECT = 32
LEFT = 256
#: Differences of a centre that are known as common: they come last in prefixes.
COMMON = 2048
SLACK = 1e-9
#: A key table of so many bytes at most is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 4 << 20
_ALNUM = byte_class("alnum")
_STEP = np.uint64(0xD1342543DE82EF95)
_TO_UNIT = 2.0**-53


def _unit(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * _TO_UNIT


def _nth(k: int) -> np.uint64:
    return np.uint64(k * int(_STEP) & 0xFFFFFFFFFFFFFFFF)


def signatures(h: np.ndarray, start: np.ndarray, registers: int) -> np.ndarray:
    """One row of register minima for each text; h holds shingle hashes, start the first of each text.

    Texts without shingles get infinities.
    """
    docs = len(start) - 1
    out = np.full((docs, registers), np.inf)
    if not len(h):
        return out
    doc = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(start))
    key = np.sort((doc << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.diff(np.append(new, len(key)))
    owner = (key[new] >> np.uint64(44)).astype(np.int64)
    shingle = key[new] & np.uint64((1 << 44) - 1)
    # a root interval (low, low + width] for each power of two below the weight
    roots = [(np.arange(len(new)), 0, 1)]
    low = 1
    while (more := np.flatnonzero(weight > low)).size:
        roots.append((more, low, low))
        low *= 2
    index = np.concatenate([r[0] for r in roots])
    base = np.concatenate([np.full(len(r[0]), r[1], np.int64) for r in roots])
    width = np.concatenate([np.full(len(r[0]), r[2], np.int64) for r in roots])
    seed = mix(shingle[index] * _STEP + base.astype(np.uint64))
    of, most = owner[index], weight[index]
    total = np.bincount(owner, weights=weight, minlength=docs)
    bound = np.where(total > 0, (np.log(registers) + 2) / np.maximum(total, 1), 0.0)
    flat = out.reshape(-1)
    todo = np.arange(len(of))
    while len(todo):
        e, limit = todo, bound[of[todo]]
        rate = registers * width[e].astype(np.float64)
        s, w, b, m, d = seed[e], width[e], base[e], most[e], of[e]
        x = np.zeros(len(e))
        k = 0
        while len(x):
            k += 1
            bits = mix(s + _nth(2 * k))
            x = x - np.log(_unit(bits)) / rate
            live = x < limit
            if not live.all():
                x, s, w, b, m, d, rate, limit = x[live], s[live], w[live], b[live], m[live], d[live], rate[live], limit[live]
            if not len(x):
                break
            bits = mix(s + _nth(2 * k + 1))
            register = (bits % np.uint64(registers)).astype(np.int64)
            level = b + 1 + ((bits >> np.uint64(32)) * w.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            counts = level <= m
            np.minimum.at(flat, (d * registers + register)[counts], x[counts])
        unfilled = np.isinf(out).any(axis=1) & (total > 0)
        todo = np.flatnonzero(unfilled[of])
        bound = np.where(unfilled, bound * 2, bound)
        if unfilled.any():
            out[unfilled] = np.inf
    return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    h = np.zeros((len(signature), bands), np.uint64)
    for k in range(rows):
        h = mix(h * _STEP + bits[:, :, k])
    return mix(h + np.arange(1, bands + 1, dtype=np.uint64) * _STEP).view(np.int64)


def _node(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's whole word sequence."""
    data = w.tobytes()
    digests = b"".join(hashlib.md5(data[8 * a : 8 * b], usedforsecurity=False).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def sign(docs: DataFrame, *, text: str, key: str, bands: int, rows: int, shingle: int) -> DataFrame:
    """(key, row_key, h1, h2, size, bands) of every row: size counts shingles, bands is null for a text without words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, at = utf8(batch.column(2))
            w, first = words(data, at, _ALNUM)
            h, start = gram_hashes(w, first, shingle)
            band = bands_of(signatures(h, start, bands * rows), bands, rows)
            some = np.diff(first) > 0
            ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[some].reshape(-1)))
            lists = pa.ListArray.from_buffers(lists.type, len(some), [pa.array(some).buffers()[1], lists.buffers()[1]], children=[lists.values])
            h1, h2 = _node(w, first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h1), pa.array(h2), pa.array(np.diff(start)), lists], [key, "row_key", "h1", "h2", "size", "bands"])

    return docs.select(F.col(key), row_key(key, text).alias("row_key"), F.col(text).alias("__text")).mapInArrow(thrifty(run), f"`{key}` {kind}, row_key {ROW_KEY}, h1 long, h2 long, size long, bands array<long>")


ROW_KEY = "struct<a:bigint,b:bigint>"


def row_key(key: str, text: str):
    """128 bits of key and text; null is not empty."""
    parts = [x for c in (F.col(key).cast("string"), F.col(text)) for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def shingle_sets(docs: DataFrame, *, text: str, shingle: int) -> DataFrame:
    """(h1, h2, grams): each shingle hash with the number of its occurrence, so that sets stand for multisets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, at = utf8(batch.column(0))
            w, first = words(data, at, _ALNUM)
            h, start = gram_hashes(w, first, shingle)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(start))
            order = np.lexsort((h, doc))
            h = h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[order][1:] != doc[order][:-1])
            run_of = np.flatnonzero(new)
            nth = np.arange(len(h)) - np.repeat(run_of, np.diff(np.append(run_of, len(h))))
            grams = np.where(nth > 0, mix(h + nth.astype(np.uint64) * _STEP), h).view(np.int64)
            h1, h2 = _node(w, first)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(grams))], ["h1", "h2", "grams"])

    return docs.select(F.col(text).alias("__text")).mapInArrow(thrifty(run), "h1 long, h2 long, grams array<long>")


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows prove it small, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def compact(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df in one partition if its counted rows prove it small: then grouping and joining it needs no shuffle."""
    return df.coalesce(1) if rows * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of every component of the edges (a, b).

    Large-star and small-star steps until nothing changes; a hub's edges are only
    ever reduced to a minimum, which Spark does before the shuffle.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    rows, state = now.count(), None
    while True:
        now = compact(now, rows, 16)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = least.select("a", F.col("m").alias("b"))
        now = materialise(small_star.union(links).filter("a != b").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        rows, state = seen[0], seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def similarity(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """edges (a, b) with j, the exact multiset Jaccard similarity."""
    a = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = edges.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (shared / (F.size("ga") + F.size("gb") - shared)).alias("j"))


def classes(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(key, row_key, node, class_id, class_rows, first) of every row.

    class_id is the least key of the class (of equal or linked texts), first says
    whether the row holds it; rows that share key and text share all of this.
    node is null for a text without words.
    """
    signed = materialise(sign(docs, text=text, key=key, bands=bands, rows=rows, shingle=shingle), "signatures")
    nodes = signed.filter("bands is not null").groupBy("h1", "h2").agg(F.first("bands").alias("bands"), F.first("size").alias("size"), F.min("row_key").alias("row_key")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes, "nodes")
    meets = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = meets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(meets.join(shared, "bucket"), "buckets")
    labels = link(docs, nodes, members, text=text, key=key, threshold=threshold, shingle=shingle)
    named = nodes.select("h1", "h2", "node")
    if labels is not None:
        named = named.join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("node"))
    placed = signed.select(key, "row_key", "h1", "h2", F.col("bands").isNotNull().alias("worded"))
    full = placed.filter("worded").join(named, ["h1", "h2"]).select(key, "row_key", "node")
    of = full.groupBy("node").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("class_rows"), F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("row_key").alias("r"))).alias("head"))
    out = full.join(of, "node").select(key, "row_key", "node", "class_id", "class_rows", (F.col("row_key") == F.col("head.r")).alias("first"))
    alone = placed.filter("not worded").select(key, "row_key", F.lit(None).cast("long").alias("node"), F.col(key).alias("class_id"), F.lit(1).cast("long").alias("class_rows"), F.lit(True).alias("first"))
    return out.union(alone)


def link(docs: DataFrame, nodes: DataFrame, members: DataFrame, *, text: str, key: str, threshold: float, shingle: int) -> DataFrame | None:
    """Components of the verified links among the members of buckets, or None if no bucket has two."""
    candidates = materialise(members.select("node").distinct().join(nodes.select("node", "h1", "h2", "row_key"), "node"), "candidates")
    n = candidates.count()
    if not n:
        return None
    name = spare(docs, "__row_key")
    read = docs.withColumn(name, row_key(key, text)).join(small(candidates.select(F.col("row_key").alias(name)), n, 48), name, "left_semi")
    sets = shingle_sets(read, text=text, shingle=shingle).join(small(candidates.select("h1", "h2", "node"), n, 64), ["h1", "h2"]).select("node", "grams")
    sets = materialise(sets, "shingles")
    if sets.select("node").distinct().count() < sets.count():  # rows that repeat key and text
        sets = materialise(sets.dropDuplicates(["node"]), "shingles")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    open_ = materialise(members.join(degree, "node").select("bucket", "node", "size", "degree"), "open")
    rows = open_.count()
    open_ = compact(open_, rows, 40)
    best = open_.groupBy("bucket").agg(F.max_by(F.struct(F.col("node").alias("v"), F.col("size").alias("sv")), F.struct("degree", "node")).alias("p")).select("bucket", "p.v", "p.sv")
    met = open_.join(best, "bucket").filter("node <> v")
    star = compare(met.filter(F.least("size", "sv") >= threshold * F.greatest("size", "sv")).select("node", "v").distinct(), sets, threshold).filter(F.col("j") >= threshold)
    links = [materialise(star.select(F.col("node").alias("a"), F.col("v").alias("b")), "links")]
    open_, pairs, most, turn = met.select("bucket", "node", "size", "degree"), [], DIRECT, 0
    while True:
        labels = components(reduce(DataFrame.union, links))
        open_ = by_class(open_, small(labels, labels.count(), 24))
        pairs.append(mates(open_.filter(F.col("n") <= most), threshold))
        large = open_.filter(F.col("n") > most).drop("n")
        rows = large.count()
        if not rows:
            break
        more, asked, open_ = centre_round(compact(large, rows, 56), sets, threshold, of_class=turn % 2 == 0)
        links.append(more)
        pairs.append(asked)
        most, turn = LEFT, turn + 1
    asked = materialise(reduce(DataFrame.union, pairs).distinct(), "pairs")
    links.append(similarity(small(asked, asked.count(), 24), sets).filter(F.col("j") >= threshold).select("a", "b"))
    return materialise(components(reduce(DataFrame.union, links)), "labels")


def by_class(open_: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, size, degree, label, n) of the buckets whose members are of two classes at least."""
    named = open_.select("bucket", "node", "size", "degree").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("bucket", "n")
    return materialise(named.join(mixed, "bucket").select("bucket", "node", "size", "degree", "label", "n"), "open")


def mates(few: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of two classes inside buckets of a bounded size whose members' sizes allow a link."""
    a = few.select("bucket", F.col("node").alias("a"), F.col("size").alias("sa"), F.col("label").alias("la"))
    b = few.select("bucket", F.col("node").alias("b"), F.col("size").alias("sb"), F.col("label").alias("lb"))
    return a.join(b, "bucket").filter("a > b AND la <> lb").filter(F.least("sa", "sb") >= threshold * F.greatest("sa", "sb")).select("a", "b").distinct()


def compare(asked: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """asked (node, v, ...) with nx, nv, d (the symmetric difference) and j, if j is `least` or more; few v are many nodes' partners."""
    asked = materialise(asked, "asked")
    asked = small(asked, asked.count(), 56)
    heads = materialise(sets.join(asked.select(F.col("v").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("v"), F.col("grams").alias("gv")), "heads")
    held = heads.agg(F.count(F.lit(1)), F.sum(F.size("gv"))).first()
    heads = small(heads, 1, 48 * held[0] + 8 * (held[1] or 0))
    both = asked.join(sets.select("node", F.col("grams").alias("gx")), "node").join(heads, "v")
    diff = F.array_union(F.array_except("gx", "gv"), F.array_except("gv", "gx"))
    seen = both.select(*asked.columns, F.size("gx").alias("nx"), F.size("gv").alias("nv"), diff.alias("d"))
    seen = seen.withColumn("j", (F.col("nx") + F.col("nv") - F.size("d")) / (F.col("nx") + F.col("nv") + F.size("d")))
    return seen.filter(F.col("j") >= least)


def centre_round(open_: DataFrame, sets: DataFrame, threshold: float, *, of_class: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, pairs to verify, what stays open) after comparing large buckets (bucket, node, size, degree, label) with a centre each."""
    # both bounds a little lower: rounded up they would lose members at exactly 0.6 or 0.4
    far, outer, part = 2 * threshold - 1 - SLACK, 3 * threshold - 2 - SLACK, (1 - threshold) / (1 + threshold)
    head = F.max_by(F.struct(F.col("node").alias("v"), F.col("size").alias("sv"), F.col("label").alias("lv")), F.struct("degree", "node")).alias("p")
    if of_class:
        main = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
        centres = main.join(open_.groupBy("label").agg(head), "label").select("bucket", "p.v", "p.sv", "p.lv")
    else:
        centres = open_.groupBy("bucket").agg(head).select("bucket", "p.v", "p.sv", "p.lv")
    met = materialise(open_.join(centres, "bucket").filter(F.least("size", "sv") >= outer * F.greatest("size", "sv")), "met")
    seen = materialise(compare(met.select("node", "v", "label", "lv").distinct(), sets, outer), "seen")
    links = seen.filter((F.col("j") >= threshold) & (F.col("label") != F.col("lv"))).select(F.col("node").alias("a"), F.col("v").alias("b"))
    gone = seen.filter(F.col("j") >= far).select("node", "v")
    left = met.select("bucket", "node", "v").join(small(gone, gone.count(), 24), ["node", "v"], "left_semi").select("bucket", "node")
    rest = open_.join(left, ["bucket", "node"], "left_anti").select("bucket", "node", "size", "degree")
    foreign = (F.col("label") != F.col("lv")) & (F.col("j") < threshold)
    # what is common among the foreign members' differences to a centre, rare ones first
    each = seen.filter(foreign).select("v", F.explode("d").alias("e")).groupBy("v", "e").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    place = F.expr("row_number() OVER (PARTITION BY v ORDER BY f DESC, e)")
    common = each.withColumn("place", place).filter(F.col("place") <= COMMON).groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "e"))), lambda x: x["e"]).alias("common"))
    some = seen.filter(foreign).select("v").distinct()
    near = seen.join(some, "v", "left_semi").join(common, "v", "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    ordered = F.concat(F.sort_array(F.array_except("d", "common")), F.array_intersect("common", "d"))
    near = near.select("node", "v", "label", "nx", "nv", F.size("d").alias("n"), foreign.alias("foreign"), ordered.alias("d"))
    # the overlap that any link of this one needs, and that a link with a foreign one needs
    own = F.col("n") - part * (1 + 1 / threshold) * F.col("nx")
    ask = F.greatest(own, (F.col("n") + part * (F.col("nv") - F.col("nx"))) / 2)
    prefix = lambda need: F.slice("d", 1, (F.col("n") - F.greatest(F.lit(1), F.ceil(need - SLACK)) + 1).cast("int"))
    near = materialise(near.filter("n > 0"), "near")
    side = lambda df, need, tag: df.select("v", F.col("node").alias(tag), F.col("label").alias(f"l{tag}"), F.col("nx").alias(f"w{tag}"), F.col("n").alias(f"n{tag}"), F.posexplode(prefix(need)).alias(f"i{tag}", "e"))
    has, asks = side(near.filter("foreign"), own, "x"), side(near, ask, "y")
    need = (F.col("nx") + F.col("ny") - part * (F.col("wx") + F.col("wy"))) / 2 - SLACK
    can = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))  # if this is the first element in common
    pairs = has.join(asks, ["v", "e"]).filter((F.col("lx") != F.col("ly")) & (can >= need) & (F.least("wx", "wy") >= threshold * F.greatest("wx", "wy")))
    pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    return links, materialise(pairs, "pairs"), rest


def keep_first(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each class; its columns stay."""
    name = spare(docs, "__row_key")
    found = classes(docs, text=text, key=key)
    rows = materialise(found.groupBy("row_key").agg(F.bool_or("first").alias("first"), F.count(F.lit(1)).alias("n")), "rows")
    gone = rows.filter("not first").select(F.col("row_key").alias(name))
    kept = docs.withColumn(name, row_key(key, text)).join(small(gone, gone.count(), 48), name, "left_anti")
    worded = F.regexp_like(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]|[A-Z]"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if rows.filter("first and n > 1").isEmpty():
        return kept.select(*columns)
    return kept.filter(worded).dropDuplicates([name]).union(kept.filter(~worded)).select(*columns)


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_rows", F.col("first").alias("representative"))


QUERIES = {"op6_bagminhash": op6_bagminhash}
