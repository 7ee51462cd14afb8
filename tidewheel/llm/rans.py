"""Operator 9: token ids in binary files, coded by a static range asymmetric numeral system.

All blocks share one frequency table, counted over the corpus and scaled to a
power of two. A block is a run of whole documents in key order; its tokens are
dealt to LANES interleaved coders that numpy steps together. A block carries its
documents' lengths, the coders' states at regular checkpoints with the place in
the word stream, and a CRC-32 of each stretch between checkpoints, so that
blocks, and stretches inside one, decode alone.

Format, little-endian. A file is a sequence of blocks; the folder `index` says
where each block lies. A block is: magic, documents, tokens, lanes, scale bits,
checkpoints, words (7 x uint32); keys (int64) and a null flag (uint8) of each
document; tokens of each document (uint32); for each checkpoint its word offset
(uint32), CRC-32 (uint32) and lane states (lanes x uint64); the words (uint32).
`table` holds (token, frequency).

Documents are put in order by a range shuffle of their coded ids, so no task
sees more than its range. Files are written to the shared folder under a name
of their own for each task attempt and named by the index that the attempt that
succeeded returns; a lost executor leaves at most an unnamed file.

Defined cases: a null text is empty and has only its end id; null keys come
first; rows that share a key follow in the order of their ids; other columns are
not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import byte_class, file_system, materialise, mix, new_path, offsets_of, slices, table, thrifty, utf8, word_places

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAGIC = 0x31534E52
LANES = 1024
CHECKPOINT_STEPS = 256
BLOCK_TOKENS = 1 << 20
LOW = 1 << 31
#: Words whose ids a worker keeps; so many newer ones are looked up apart before they join the others.
MEMO = 1_000_000
FRESH = 30_000
_SPACE = byte_class("space")
#: Fixed value: the pattern by which such a file cuts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
#: ASCII marks but the apostrophe, which may begin a token with letters.
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])


def runs(raw: np.ndarray) -> np.ndarray:
    """Where a mark follows a letter or a letter a mark: the pattern always cuts there. Letters are ASCII's and those of U+00C0 to U+024F."""
    lead = (raw >= 0xC3) & (raw <= 0xC9)
    lead[:-1] &= ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))  # the signs of multiplication and division
    letter, mark = _ASCII_LETTER[raw], _MARK[raw]
    ends = letter.copy()
    ends[1:] |= lead[:-1]
    out = np.zeros(len(raw), bool)
    out[1:] = (mark[1:] & ends[:-1]) | (mark[:-1] & (letter | lead)[1:])
    return out


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Ids of words by hash, in sorted arrays."""

    def __init__(self, kind: np.dtype):
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, kind)

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        begin = len(self.ids) + np.cumsum(size) - size
        keys, begin, size = np.concatenate([self.keys, keys]), np.concatenate([self.begin, begin]), np.concatenate([self.size, size])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.size = keys[order], begin[order], size[order]
        self.ids = np.concatenate([self.ids, ids])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is there)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


class WordTokenizer:
    """The library's tokenizer with a memo of words: white space always parts its tokens.

    A slice's words are told apart by hash; only those not seen before go to the
    library, and ids of all words are gathered at once. If the file drops case and
    cuts words by PATTERN, words are cut into runs of letters and marks first,
    but where a special token's string occurs.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known, self.fresh = Memo(self.kind), Memo(self.kind)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["normalizer"] or {}).get("normalizers") or [spec["normalizer"] or {}]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"] or {}]
        self.plain = any(x.get("type") == "Lowercase" for x in steps) and cuts[0].get("pattern") == {"Regex": PATTERN}
        self.special = [x["content"].encode() for x in spec["added_tokens"]]

    def learn(self, keys: np.ndarray, names: list[str]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.fresh.add(keys, size, np.fromiter(chain.from_iterable(found), self.kind, int(size.sum())))

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; where each text begins)."""
        data, at = utf8(column)
        raw = data.tobytes()
        cut = self.plain and not any(x in raw for x in self.special)
        h, first, begin, stop = word_places(data, at, _SPACE, fold=cut, parts=runs if cut else None)
        if not cut:
            h = mix(h)  # cut and whole words are told apart
        keys, rank, which = np.unique(h, return_index=True, return_inverse=True)
        old, is_old = self.known.find(keys)
        new, is_new = self.fresh.find(keys)
        missing = np.flatnonzero(~is_old & ~is_new)
        if len(missing):
            for part in np.array_split(missing, -(-len(missing) // 4096)):
                self.learn(keys[part], [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[rank[part]].tolist(), stop[rank[part]].tolist(), strict=True)])
            new, is_new = self.fresh.find(keys)
        ids = np.concatenate([self.known.ids, self.fresh.ids]) if is_old.any() else self.fresh.ids
        place, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        place[is_old], size[is_old] = self.known.begin[old[is_old]], self.known.size[old[is_old]]
        shift = len(self.known.ids) if is_old.any() else 0
        place[is_new], size[is_new] = self.fresh.begin[new[is_new]] + shift, self.fresh.size[new[is_new]]
        each = size[which]
        upto = np.concatenate([[0], np.cumsum(each)])
        edges = upto[first] + np.arange(len(first))
        out = np.full(edges[-1], end_id, self.kind)
        body = np.ones(edges[-1], bool)
        body[edges[1:] - 1] = False
        out[body] = ids[np.repeat(place[which] - upto[:-1], each) + np.arange(upto[-1])]
        if len(self.fresh.keys) > FRESH:
            if len(self.known.keys) > MEMO:
                self.known = Memo(self.kind)
            self.known.add(self.fresh.keys, self.fresh.size, self.fresh.ids[np.repeat(self.fresh.begin - (np.cumsum(self.fresh.size) - self.fresh.size), self.fresh.size) + np.arange(self.fresh.size.sum())])
            self.fresh = Memo(self.kind)
        return out, edges


@lru_cache(1)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """(key long, n_tokens long, ids binary) of every row; ids are little-endian uint16, or uint32 for a large vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for batch in slices(batches, "t"):
            ids, edges = t.encode(batch.column(1), end_id)
            width = t.kind.itemsize
            rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(edges * width), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edges)), rows], ["key", "n_tokens", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t")).mapInArrow(thrifty(run), "key long, n_tokens long, ids binary")


def frequencies(tokens: DataFrame, kind: str) -> dict[int, int]:
    """Counts of every token that occurs; bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = _binary(batch.column(0), kind)
            seen = np.bincount(data, minlength=len(total))
            seen[: len(total)] += total
            total = seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])

    rows = tokens.select("ids").mapInArrow(thrifty(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r[0]: r[1] for r in rows}


def _binary(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    at = offsets_of(column)
    size = np.dtype(kind).itemsize
    n = int(at[-1] - at[0])
    data = np.frombuffer(column.buffers()[2], np.uint8, count=n, offset=int(at[0])) if n else np.zeros(0, np.uint8)
    return data.view(kind) if not data.ctypes.data % size else np.frombuffer(data.tobytes(), kind), (at - at[0]) // size


class Table:
    """Scaled frequencies: every token that occurs has a slot, all slots make 2**bits."""

    def __init__(self, counts: dict[int, int], bits: int | None = None):
        tokens = sorted(counts)
        self.bits = bits or max(20, int(np.ceil(np.log2(max(2, len(tokens))))) + 4)
        n = np.array([counts[t] for t in tokens], np.float64)
        space = 1 << self.bits
        f = np.maximum(1, np.floor(n * (space / n.sum()))).astype(np.int64) if len(n) else np.zeros(0, np.int64)
        extra = space - int(f.sum()) if len(n) else 0
        order = np.argsort(-n, kind="stable")
        if extra > 0:
            f[order[0]] += extra
        while extra < 0:  # rare tokens took more than there was: the frequent ones give it back
            take = np.minimum(f[order] - 1, np.maximum(1, f[order] // 64))
            upto = np.cumsum(take)
            cut = min(len(order), int(np.searchsorted(upto, -extra)) + 1)
            give = take[:cut].copy()
            give[-1] -= max(0, int(upto[cut - 1]) + extra)
            f[order[:cut]] -= give
            extra += int(give.sum())
        size = (tokens[-1] + 1) if tokens else 1
        self.tokens = np.array(tokens, np.int64)
        self.freq = np.zeros(size, np.uint64)
        self.freq[self.tokens] = f.astype(np.uint64)
        self.start = np.zeros(size, np.uint64)
        self.start[self.tokens] = (np.cumsum(f) - f).astype(np.uint64)
        self.slot = np.repeat(self.tokens, f).astype(np.uint32)


def encode(ids: np.ndarray, t: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> tuple[list[tuple[int, int, np.ndarray]], np.ndarray]:
    """(checkpoints, words): each checkpoint has its word offset, CRC-32 and lane states."""
    ids = np.asarray(ids, np.int64)
    steps = -(-len(ids) // lanes)
    freq, start = t.freq[ids], t.start[ids]
    bits, low32 = np.uint64(t.bits), np.uint64(0xFFFFFFFF)
    limit = freq << np.uint64(63 - t.bits)
    x = np.full(lanes, LOW, np.uint64)
    chunks: list[np.ndarray] = []
    sent = 0
    marks: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min((step + 1) * lanes, len(ids))
        y, f = x[: b - a], freq[a:b]
        full = y >= limit[a:b]
        out = y[full]
        if len(out):
            chunks.append((out & low32).astype(np.uint32))
            sent += len(out)
            y[full] = out >> np.uint64(32)
        q = y // f
        x[: b - a] = (q << bits) + (y - q * f) + start[a:b]
        if step % every == 0:
            marks.append((sent, x.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    raw = ids.astype("<u4")
    span = every * lanes
    points = [(sent - at, zlib.crc32(raw[k * span : (k + 1) * span].tobytes()), state) for k, (at, state) in enumerate(reversed(marks))]
    return points, words


def decode(points: list, words: np.ndarray, n: int, t: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS, first: int = 0, last: int | None = None) -> np.ndarray:
    """Tokens of the stretches first..last (exclusive) of a block of n tokens; checks their CRCs."""
    last = len(points) if last is None else last
    span = every * lanes
    begin, end = first * span, min(last * span, n)
    out = np.empty(max(0, end - begin), np.uint32)
    bits, mask, low = np.uint64(t.bits), np.uint64((1 << t.bits) - 1), np.uint64(LOW)
    for k in range(first, last):
        pos, crc, state = points[k]
        x = state.astype(np.uint64)
        for a in range(k * span, min((k + 1) * span, n), lanes):
            b = min(a + lanes, n)
            y = x[: b - a]
            slot = y & mask
            token = t.slot[slot]
            out[a - begin : b - begin] = token
            y = t.freq[token] * (y >> bits) + slot - t.start[token]
            need = np.flatnonzero(y < low)
            if len(need):
                y[need] = (y[need] << np.uint64(32)) | words[pos : pos + len(need)].astype(np.uint64)
                pos += len(need)
            x[: b - a] = y
        piece = out[k * span - begin : min((k + 1) * span, n) - begin]
        if zlib.crc32(piece.astype("<u4").tobytes()) != crc:
            raise ValueError(f"checksum of stretch {k} does not match")
    return out


def pack(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray, t: Table) -> bytes:
    points, words = encode(ids, t)
    head = np.array([MAGIC, len(keys), len(ids), LANES, t.bits, len(points), len(words)], "<u4").tobytes()
    parts = [head, np.array([0 if k is None else k for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], np.uint8).tobytes(), sizes.astype("<u4").tobytes()]
    for at, crc, state in points:
        parts += [np.array([at, crc], "<u4").tobytes(), state.astype("<u8").tobytes()]
    return b"".join([*parts, words.astype("<u4").tobytes()])


def unpack(data: bytes, t: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, tokens of each document, ids) of a block."""
    magic, docs, n, lanes, bits, checkpoints, n_words = np.frombuffer(data, "<u4", 7).tolist()
    if magic != MAGIC or bits != t.bits:
        raise ValueError("not a block of this table")
    at = 28
    keys = np.frombuffer(data, "<i8", docs, at).tolist()
    nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    points = []
    for _ in range(checkpoints):
        pos, crc = np.frombuffer(data, "<u4", 2, at).tolist()
        points.append((pos, crc, np.frombuffer(data, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    words = np.frombuffer(data, "<u4", n_words, at)
    ids = decode(points, words, n, t, lanes)
    return [None if z else k for k, z in zip(keys, nulls.tolist(), strict=True)], sizes, ids


INDEX = "file string, part int, block int, offset long, length long, n_docs long, n_tokens long"


def write_tokens(tokens: DataFrame, folder: str, *, kind: str = "<u2") -> None:
    """Write tokens (key, n_tokens, ids) into a folder of blocks, an index and the shared table.

    `tokens` is read more than once, so it should be a stored table.
    """
    spark = tokens.sparkSession
    counts = frequencies(tokens, kind)
    spark.createDataFrame(sorted(counts.items()), "token long, n long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(counts)  # bounded by the vocabulary
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.repartitionByRange(parts, "key").sortWithinPartitions("key", "ids")
    spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/blocks").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        t = Table(shared.value)
        fs, path = file_system(f"{folder}/blocks")
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rans"
        rows: list[tuple] = []
        keys: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = offset = 0
        out = None
        for batch in _pieces(batches, kind):
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}")
            k, n, x = batch
            keys += k
            sizes.append(n)
            ids.append(x)
            held += len(x)
            if held >= BLOCK_TOKENS:
                offset, held = _flush(out, rows, name, part, offset, keys, sizes, ids, t), 0
        if keys:
            _flush(out, rows, name, part, offset, keys, sizes, ids, t)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind_) for c, kind_ in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["file", "part", "block", "offset", "length", "n_docs", "n_tokens"])

    ordered.select("key", "ids").mapInArrow(thrifty(run), INDEX).write.parquet(f"{folder}/index")


def _pieces(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, sizes, ids) in pieces far below a block's size, so that blocks end near it."""
    for batch in slices(batches, "ids", BLOCK_TOKENS // 4):
        data, at = _binary(batch.column(1), kind)
        yield batch.column(0).to_pylist(), np.diff(at), data


def _flush(out, rows: list, name: str, part: int, offset: int, keys: list, sizes: list, ids: list, t: Table) -> int:
    data = pack(keys, np.concatenate(sizes), np.concatenate(ids), t)
    out.write(data)
    rows.append((name, part, len(rows), offset, len(data), len(keys), int(sum(map(len, ids)))))
    keys.clear()
    sizes.clear()
    ids.clear()
    return offset + len(data)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids binary) of every document; ids are little-endian uint32, start counts all ids before.

    One row of the index is decoded at a time; starts come from the totals of
    files, then of blocks, so only one number a file meets in one place.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    counts = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/table").collect()}
    shared = spark.sparkContext.broadcast(counts)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = index.withColumn("inside", inside).join(parts, "part").select("file", "offset", "length", (F.col("part_start") + F.col("inside")).alias("start"))
    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(shared.value)
        fs, path = file_system(f"{folder}/blocks")
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{path}/{row['file']}") as f:
                    f.seek(row["offset"])
                    data = f.read(row["length"])
                keys, sizes, ids = unpack(data, t)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                for a in range(0, len(keys), 512):
                    b = min(a + 512, len(keys))
                    rows = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends[a:b].tolist(), sizes[a:b].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(row["start"] + ends[a:b] - sizes[a:b]), pa.array(sizes[a:b]), pa.array(rows, pa.binary())], ["key", "start", "n_tokens", "ids"])

    return placed.repartition(many, "file", "offset").mapInArrow(thrifty(run), "key long, start long, n_tokens long, ids binary")


def op9_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = vocabulary_path(), new_path(spark, "rans")
    tokens = materialise(tokenize(table(spark, sf_dir, "documents"), path), "tokens")
    write_tokens(tokens, folder, kind=load(path).kind.str)
    return read_tokens(spark, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op9_rans_tokens": op9_rans_tokens}
