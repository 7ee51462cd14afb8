"""What the corpus operators share: tables, the shared folder, numpy text kernels.

Arrow hands a task its texts as one byte buffer with offsets. The kernels here
work on that buffer in windows of a few MB, so that a task's memory does not
depend on the size of its partition or on the longest text.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
WINDOW_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is taken only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidewheel/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, nothing is computed twice."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """name, or one like it that df has no column of (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def thrifty(run: Callable) -> Callable:
    """A mapper for mapInArrow or an Arrow UDF that gives its memory back when a task ends.

    Workers are used again, and would keep the peak of every kind of task they ran.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return wrapped


def arrow_column(run: Callable, kind: str) -> Callable:
    """A column function from an Arrow mapper: only its arguments go to Python, and it runs once though used twice."""
    run = thrifty(run)

    def mapped(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(columns)

    return F.arrow_udf(mapped, kind).asNondeterministic()


def file_system(uri: str):
    """(pyarrow file system, path) of a folder named by Hadoop's rules."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def put(folder: str, name: str, array: np.ndarray) -> None:
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}") as f:
        f.write(np.ascontiguousarray(array).tobytes())


_maps: dict[tuple[str, str], np.ndarray] = {}


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file of the shared folder as a mapped array."""
    if (folder, name) not in _maps:
        from pyarrow import fs as pafs

        fs, path = file_system(folder)
        local = f"{path}/{name}"
        if not isinstance(fs, pafs.LocalFileSystem):
            import tempfile

            local = os.path.join(tempfile.gettempdir(), f"{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}-{name}")
            if not os.path.exists(local):
                part = f"{local}.{uuid.uuid4().hex}"
                pafs.copy_files(f"{path}/{name}", part, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
                os.replace(part, local)
        if len(_maps) > 50_000:
            _maps.clear()
        _maps[folder, name] = np.memmap(local, kind, mode="r") if os.path.getsize(local) else np.zeros(0, kind)
    return _maps[folder, name]


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64)
    found = np.frombuffer(column.buffers()[1], kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize)
    return found.astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the byte offset of each text; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    at = offsets_of(column)
    data = column.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8, count=int(at[-1] - at[0]), offset=int(at[0])), at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about `most` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = offsets_of(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(at, at[begin] + most, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def pieces(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Columns of texts cut like slices(): results leave piece by piece, so no task holds those of a whole batch."""
    for column in columns:
        for part in slices(iter([pa.RecordBatch.from_arrays([column], ["t"])]), "t"):
            yield part.column(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_class(words: str) -> np.ndarray:
    """For each byte its lower-case value as part of a word, or 0 if it separates.

    'alnum': [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.
    'space': [^\\x20\\x09-\\x0D]+ after lower-casing A-Z.
    """
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    if words == "alnum":
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    else:
        keep = np.ones(256, bool)
        keep[[9, 10, 11, 12, 13, 32]] = False
        out[0] = 1  # NUL belongs to a word here; hashes use the byte itself
    return np.where(keep, out, 0).astype(np.uint8)


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, WINDOW_BYTES)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


#: Pieces of so many values are told apart by a digest: over 2^64 any polynomial has equal sums of some long pieces.
LONG = 256


def hash_pieces(values: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece [begin, stop) of well-mixed values: of what it holds, wherever it lies."""
    up, down = _power_tables(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    out = mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    for k in np.flatnonzero(stop - begin >= LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(values[begin[k] : stop[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word in lower case (A-Z), and for each text the index of its first word.

    Windows end between words, so long texts need no more memory than short ones.
    """
    return word_places(data, at, classes)[:2]


def word_places(data: np.ndarray, at: np.ndarray, classes: np.ndarray, *, fold: bool = True, parts: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() with the first byte of every word and the byte after it; without fold, case counts.

    parts marks the bytes at which a word is cut, of the bytes of a window.
    """
    found: list[np.ndarray] = []
    begins: list[np.ndarray] = []
    stops: list[np.ndarray] = []
    first = np.zeros(len(at), np.int64)
    total = pos = doc = 0
    n = len(data)
    while pos < n:
        end = min(pos + WINDOW_BYTES, n)
        if end < n:
            cut = np.flatnonzero(classes[data[pos:end]] == 0)
            if len(cut):
                end = pos + int(cut[-1]) + 1
            else:  # one word fills the window: go on to its end
                while end < n and classes[data[end - 1]]:
                    more = np.flatnonzero(classes[data[end : end + WINDOW_BYTES]] == 0)
                    end = end + int(more[0]) + 1 if len(more) else min(n, end + WINDOW_BYTES)
        raw = data[pos:end]
        inside = classes[raw] != 0
        lo = int(np.searchsorted(at, pos, "left"))
        hi = int(np.searchsorted(at, end, "left"))
        edge = np.zeros(end - pos + 1, bool)
        edge[at[lo:hi] - pos] = True
        edge[0] = edge[-1] = True
        if parts is not None:
            edge[:-1] |= parts(raw)
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        begin = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
        lower = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32) if fold else raw
        found.append(hash_pieces(_VALUES[lower], begin, stop))
        begins.append(begin + pos)
        stops.append(stop + pos)
        if hi > lo:
            first[lo:hi] = total + np.searchsorted(begin, at[lo:hi] - pos, "left")
        total += len(begin)
        pos = end
    first[np.searchsorted(at, n, "left") :] = total
    if not n:
        first[:] = 0
    whole = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return whole(found, np.uint64), first, whole(begins, np.int64), whole(stops, np.int64)


def gram_hashes(w: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of n words inside one text, and the first window of each text.

    A text of fewer words, but not none, has one window: all its words.
    """
    count = np.diff(first)
    windows = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    start = np.zeros(len(first), np.int64)
    np.cumsum(windows, out=start[1:])
    if not start[-1]:
        return np.zeros(0, np.uint64), start
    doc = np.repeat(np.arange(len(count)), windows)
    begin = first[doc] + (np.arange(start[-1]) - start[doc])
    length = np.minimum(count[doc], n)
    h = np.zeros(len(doc), np.uint64)
    for k in range(n):
        has = length > k
        if has.all():
            h = h * np.uint64(_BASE) + w[begin + k]
        else:
            h[has] = h[has] * np.uint64(_BASE) + w[begin[has] + k]
    return mix(h), start
