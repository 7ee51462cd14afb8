"""Operator 13: near-duplicates by SimHash, with pigeonhole blocks.

A text's fingerprint has a bit set if over half of its shingles' 64-bit hashes
have it. Two fingerprints that differ in at most three bits agree in one of four
blocks of 16 bits, so fingerprints meet by block and value, and the Hamming
distance decides.

Fingerprints are made distinct first: copies never meet. Buckets are counted
before anyone meets in them:

- up to SPLIT members: one task compares them as a stretch of sorted rows;
- more: each member is dealt again by four blocks of the 48 bits that are left,
  where the same argument holds, so 28 bits tell the new buckets apart;
- over LIMIT members even then: each member marks every value within two bits.
  Of two fingerprints at distance three, one is within one bit and the other
  within two bits of some value, so they meet there; at most 2081 fingerprints
  can meet at a value, and each is linked to one that is within a bit of it.

All three are exact; the sizes choose the way, never what is found. A bucket
leaves its members' links to the least one they reach in it, not its pairs, so
rows grow with the members. Components come from large-star and small-star
rounds over tables in the shared folder.

Defined cases: a null or wordless text has fingerprint zero and is linked like
any other; fewer than three words are one shingle; repeated rows are rows of
their own with one component; a row without a key never names a component (its
component_id is null if no linked row has a key); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bagminhash import components
from .common import byte_class, materialise, slices, table, thrifty, utf8, word_places

SHINGLE = 3
DISTANCE = 3
SEED = 42
SPLIT, LIMIT = 4096, 32768
_SPACE = byte_class("space")
#: Primes and rotations of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_ONE_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_TWO_BITS = np.array([a | b for i, a in enumerate(_ONE_BIT.tolist()) for b in _ONE_BIT.tolist()[i + 1 :]], np.uint64)


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(lane: np.ndarray) -> np.ndarray:
    return _turn(lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every piece of data; pieces of one size are hashed together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    out = np.empty(len(begin), np.uint64)
    order = np.argsort(size, kind="stable")
    at = np.concatenate([[0], np.flatnonzero(np.diff(size[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    with np.errstate(over="ignore"):
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rows = order[lo:hi]
            out[rows] = _equal_sizes(padded, eight, four, begin[rows], int(size[rows[0]]), np.uint64(seed))
    return out


def _equal_sizes(data: np.ndarray, eight: np.ndarray, four: np.ndarray, p: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    done = 0
    if n >= 32:
        lanes = [np.full(len(p), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while done + 32 <= n:
            lanes = [_turn(v + eight[p + done + 8 * k] * _P2, 31) * _P1 for k, v in enumerate(lanes)]
            done += 32
        h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for v in lanes:
            h = (h ^ _round(v)) * _P1 + _P4
    else:
        h = np.full(len(p), seed + _P5, np.uint64)
    h = h + np.uint64(n)
    while done + 8 <= n:
        h = _turn(h ^ _round(eight[p + done]), 27) * _P1 + _P4
        done += 8
    if done + 4 <= n:
        h = _turn(h ^ (four[p + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
        done += 4
    while done < n:
        h = _turn(h ^ (data[p + done].astype(np.uint64) * _P5), 11) * _P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def majority(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each stretch of h the bits that over half of its hashes have; an empty stretch has none.

    Eight counters of a byte lie in a word, so a block of 255 hashes is added at once.
    """
    n = np.diff(start)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    blocks = -(-n[some] // 255)
    first = np.concatenate([[0], np.cumsum(blocks)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    cuts = np.repeat(start[some], blocks) + 255 * nth
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & lanes, cuts)
        counts = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first[:-1], axis=0)
        over = 2 * counts > n[some][:, None]
        out[some] |= (over.astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints_of(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every text of a byte buffer, by the offsets of its texts."""
    _, first, begin, stop = word_places(data, at, _SPACE)
    size = stop - begin
    placed = np.concatenate([[0], np.cumsum(size + 1)])  # each word and one blank, and nothing else
    joined = np.full(placed[-1], 32, np.uint8)
    inside = np.ones(placed[-1], bool)
    inside[placed[1:] - 1] = False
    joined[inside] = data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    joined += ((joined >= 65) & (joined <= 90)).astype(np.uint8) * np.uint8(32)
    words = np.diff(first)
    count = np.where(words >= shingle, words - shingle + 1, (words > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    head = first[doc] + np.arange(start[-1]) - start[doc]
    last = head + np.minimum(words[doc], shingle)
    return majority(xxh64(joined, placed[head], placed[last] - 1 - placed[head]), start)


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp long) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = fingerprints_of(*utf8(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(thrifty(run), f"`{key}` {kind}, fp long")


def blocks_of(bits: list[int], most: int = DISTANCE) -> list[list[int]]:
    """The bits in most + 1 blocks; of two values that differ in `most` of them, one block is equal."""
    return [bits[k * len(bits) // (most + 1) : (k + 1) * len(bits) // (most + 1)] for k in range(most + 1)]


def picked(fp, bits: list[int]):
    """The given bits of fp, which are consecutive stretches, packed from the lowest on."""
    out, low = F.lit(0).cast("long"), 0
    while bits:
        n = next((k for k in range(1, len(bits)) if bits[k] != bits[0] + k), len(bits))
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, bits[0]).bitwiseAND(F.lit((1 << n) - 1).cast("long")), low))
        bits, low = bits[n:], low + n
    return out


def dealt(fps: DataFrame) -> DataFrame:
    """(block, value, fp): every fingerprint in its four blocks of 16 bits."""
    keys = [F.struct(F.lit(k).alias("block"), picked(F.col("fp"), bits).alias("value")) for k, bits in enumerate(blocks_of(list(range(64))))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.*", "fp")


def dealt_again(members: DataFrame) -> DataFrame:
    """(block, value, fp): members of a block in four blocks of their other bits; block and value name both."""
    keys = []
    for k, bits in enumerate(blocks_of(list(range(64)))):
        rest = [b for b in range(64) if b not in bits]
        for j, more in enumerate(blocks_of(rest)):
            # sorted bits come in few stretches, and the order of bits does not matter
            keys.append((k, F.struct(F.lit(4 + 4 * k + j).alias("block"), picked(F.col("fp"), sorted(bits + more)).alias("value"))))
    each = F.array(*(F.when(F.col("block") == k, x) for k, x in keys))
    return members.select("fp", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("k")).select("k.*", "fp")


def reached(fp: np.ndarray) -> np.ndarray:
    """For each of distinct fingerprints the least that links of at most DISTANCE bits lead to; only those not yet reached are compared."""
    order = np.argsort(fp)
    left, label = order, np.empty(len(fp), np.uint64)
    while len(left):
        root, front, left = fp[left[0]], left[:1], left[1:]
        label[front] = root
        while len(front) and len(left):
            now, front = front[:64], front[64:]
            near = (np.bitwise_count(fp[now][:, None] ^ fp[left][None, :]) <= DISTANCE).any(axis=0)
            label[left[near]] = root
            front, left = np.concatenate([front, left[near]]), left[~near]
    return label


#: Stretches up to this many rows are compared by shifting the whole batch.
SHIFTS = 16


def links_of(name: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) inside the stretches of equal name: pairs in short ones, to the least reached one in others."""
    edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    size = np.diff(np.append(edge, len(name)))
    short = np.repeat(size <= SHIFTS, size)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for shift in range(1, min(SHIFTS, int(size.max(initial=1)))):
        near = (name[shift:] == name[:-shift]) & short[shift:] & (np.bitwise_count(fp[shift:] ^ fp[:-shift]) <= DISTANCE)
        a.append(fp[shift:][near])
        b.append(fp[:-shift][near])
    for k in np.flatnonzero(size > SHIFTS).tolist():
        own = fp[edge[k] : edge[k] + size[k]]
        label = reached(own)
        a.append(own[own != label])
        b.append(label[own != label])
    return np.concatenate(a), np.concatenate(b)


def compared(buckets: DataFrame) -> DataFrame:
    """Links (a, b) among members (block, value, fp) of buckets, each of a counted size; a task reads them as sorted stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.uint64)  # the last bucket of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            value, fp = (batch.column(k).to_numpy().view(np.uint64) for k in (1, 2))
            name = (batch.column(0).to_numpy().astype(np.uint64) << np.uint64(48)) | value
            held = np.concatenate([held, np.stack([name, fp])], axis=1)
            cut = int(np.searchsorted(-(held[0] != held[0][-1]).astype(np.int8), 0))
            yield pair(*links_of(held[0][:cut], held[1][:cut]))
            held = held[:, cut:]
        if held.shape[1]:
            yield pair(*links_of(*held))

    def pair(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return buckets.repartition("block", "value").sortWithinPartitions("block", "value").mapInArrow(thrifty(run), "a long, b long")


def by_neighbours(crowded: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever of the fingerprints (fp) is linked, by the values around each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in np.array_split(batch.column(0).to_numpy().view(np.uint64), -(-batch.num_rows // 64) or 1):
                around = np.concatenate([fp[:, None], fp[:, None] ^ _ONE_BIT, fp[:, None] ^ _TWO_BITS], axis=1)
                close = np.broadcast_to(np.arange(around.shape[1]) <= 64, around.shape)
                yield pa.RecordBatch.from_arrays([pa.array(around.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, around.shape[1]).view(np.int64)), pa.array(close.reshape(-1))], ["value", "fp", "close"])

    marks = crowded.mapInArrow(thrifty(run), "value long, fp long, close boolean")
    heads = marks.groupBy("value").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("head"), F.count(F.lit(1)).alias("n")).filter("head IS NOT NULL AND n > 1")
    return marks.join(heads, "value").select(F.col("fp").alias("a"), F.col("head").alias("b")).filter("a <> b").distinct()


def links(fps: DataFrame, *, split: int = SPLIT, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct fingerprints (fp) within DISTANCE bits."""
    sized = lambda d: materialise(d.join(d.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["block", "value"]), "simhash-buckets")
    members = sized(dealt(fps))
    out = compared(members.filter(F.col("n") <= split).select("block", "value", "fp"))
    large = members.filter(F.col("n") > split).select("block", "value", "fp")
    if large.isEmpty():
        return out
    again = sized(dealt_again(large))
    out = out.union(compared(again.filter(F.col("n") <= limit).select("block", "value", "fp")))
    crowded = again.filter(F.col("n") > limit).select("fp").distinct()
    return out if crowded.isEmpty() else out.union(by_neighbours(crowded))


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, split: int = SPLIT, limit: int = LIMIT) -> DataFrame:
    """(key, fp, component_id) of every row: component_id is the least key that links of at most DISTANCE bits reach.

    split and limit say from which size of a bucket on its members are dealt again
    and probed; the result does not depend on them.
    """
    signed = materialise(fingerprints(docs, text=text, key=key, shingle=shingle), "simhash")
    least = materialise(signed.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    named = components(links(least.select("fp"), split=split, limit=limit)).withColumnRenamed("node", "fp")
    labelled = least.join(named, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    of = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    # fingerprints are few against their copies: each copies' component is joined once a fingerprint, the copies of one may be many
    component = labelled.select("fp", "label").join(of, "label").select("fp", "component_id")
    return signed.join(component, "fp").select(key, "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op13_simhash": op13_simhash}
