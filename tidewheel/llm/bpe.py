"""Operator 5: byte-level BPE by backtracking, and decoding by an offset table.

Encoding. A pre-token's bytes run once through an Aho-Corasick automaton of all
tokens, which gives the longest token starting at each byte. The encoder places
longest matches from the left; a token may follow another only if the pair is
compatible, which means that BPE on their joined bytes gives just these two.
When nothing fits it steps back and tries the next shorter token; a byte offset
that failed once is never tried again, so the work is linear in the bytes. A
sequence whose neighbours are all compatible is the one that merging by rank
gives, so the result is exact.

Decoding gathers token bytes from one array through a table of offsets.

Defined cases: a null text is empty, an empty text has no tokens; null or
repeated doc_id values are carried through, one result per input row; other
columns are not read. The vocabulary file is a parameter and must be readable
on every executor, as an installed package is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, pieces, table

VOCABULARY = "byte_bpe_50k.json"
#: Stretches whose encoding a worker keeps, in each of two generations: when the newer one is
#: full it becomes the older one, and what is used again moves up.
MEMO = 160_000

#: Fixed value: the pre-token pattern of byte-level BPE files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

OTHER_SPACE = re.compile(r"[ \n](?:\s|\Z)|\A\s").search


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """Byte-level files write each byte as a printable character: itself if printable, else 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return out


class ByteBPE:
    """A vocabulary file with its automaton, pair table and offset table."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        names = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        self.raw: dict[int, bytes] = {i: bytes(symbols[c] for c in name) for name, i in names.items()}
        self.ids = {raw.decode("latin-1"): i for i, raw in self.raw.items()}
        self.size = [0] * (max([*self.raw, *special.values()]) + 1)
        for i, raw in self.raw.items():
            self.size[i] = len(raw)
        #: (left, right) -> (rank, merged); token -> its rank and parts; single bytes have rank -1
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = dict.fromkeys(self.raw, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right, both = names[a], names[b], names[a + b]
            self.merged.setdefault((left, right), rank)
            if both not in self.parts:
                self.parts[both], self.rank[both] = (left, right), rank
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.newline = tuple(x for x in (self.ids.get("\n"),) if x is not None)
        whole = self.raw | {i: x.encode() for x, i in special.items()}
        blob = b"".join(whole.get(i, b"") for i in range(len(self.size)))
        self.blob = np.frombuffer(blob, np.uint8)
        self.offsets = np.zeros(len(self.size) + 1, np.int64)
        np.cumsum([len(whole.get(i, b"")) for i in range(len(self.size))], out=self.offsets[1:])

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            name = self.raw[token].decode("latin-1")
            self.shorter[token] = next((self.ids[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in self.ids), None)
        return self.shorter[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE on the bytes of a and b gives just a, b.

        Merging is followed back in time along the right edge of a and the left
        edge of b. A merge across the border would have happened if its rank is
        below that of the step which replaced one of its sides.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, parts, merged = self.rank, self.parts, self.merged
        bound = len(rank) + len(merged) + 1
        fits = True
        while True:
            across = merged.get((a, b))
            if across is not None and across < bound:
                fits = False
                break
            left, right = rank[a], rank[b]
            if left < 0 and right < 0:
                break
            if left > right:
                bound, a = left, parts[a][1]
            else:  # of equal ranks the left one merges first, so the right one is the later
                bound, b = right + 1, parts[b][0]
        if len(self.pairs) > 150_000:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Exact BPE of one pre-token, which has a byte at least."""
        raw = piece.encode("utf-8").decode("latin-1")
        n = len(raw)
        size, pairs = self.size, self.pairs
        #: longest token by its start; the automaton's leftmost-longest walk gives those of the greedy path
        longest = {end + 1 - size[token]: token for end, token in self.automaton.iter_long(raw)}
        closed: set[int] = set()
        out = [longest[0]]
        pos = size[longest[0]]
        while pos < n:
            token: int | None = longest.get(pos)
            if token is None:
                token = longest[pos] = next(self.automaton.iter_long(raw, pos))[1]
            while True:
                while token is not None:
                    end = pos + size[token]
                    if end not in closed:
                        if not out:
                            break
                        fits = pairs.get((out[-1], token))
                        if fits or fits is None and self.compatible(out[-1], token):
                            break
                    token = self.next_shorter(token)
                if token is not None:
                    out.append(token)
                    pos = end
                    break
                closed.add(pos)
                token = out.pop()
                pos -= size[token]
                token = self.next_shorter(token)
        return tuple(out)

    def encode_stretch(self, stretch: str) -> tuple[int, ...]:
        ids = self.older.get(stretch)
        if ids is None:
            pieces = self.split(stretch)
            if len(pieces) == 1:
                ids = self.encode_piece(stretch)
            else:
                ids = tuple(chain.from_iterable([self.memo.get(x) or self.encode_stretch(x) for x in pieces]))
        if len(stretch) <= 48:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[stretch] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Token ids of a text.

        The pattern cuts before any space or newline that a non-space follows,
        so such a text is encoded stretch by stretch, each with its leading
        space, and frequent stretches come from the memo. Texts with other
        white space are cut by the pattern as a whole.
        """
        if self.cut is not None and any(x in text for x in self.special):
            parts: Iterable[str] = self.cut.split(text)
        else:
            parts = (text,)
        found: list[tuple[int, ...]] = []
        add, encode_stretch = found.append, self.encode_stretch
        for part in parts:
            if part in self.special:
                add((self.special[part],))
                continue
            if not part:
                continue
            if OTHER_SPACE(part):
                found.extend(map(self.encode_piece, self.split(part)))
                continue
            first = True
            for line in part.split("\n"):
                if not first:
                    add(self.newline)
                first = False
                known = self.memo.get
                found.extend([known(x) or encode_stretch(x) for x in line.replace(" ", "\n ").split("\n")])
        return list(chain.from_iterable(found))

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of tokens, gathered through the offset table."""
        begin = self.offsets[ids]
        length = self.offsets[ids + 1] - begin
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(begin - (ends - length), length) + np.arange(total)]

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


CODED = "struct<ids:array<int>,decoded:string>"


def encode_decode(docs: DataFrame, path: str, *, text: str = "text", into: str = "coded") -> DataFrame:
    """docs with a column `into` of (ids, decoded), in one pass without a shuffle; only texts go to Python."""

    def coded(bpe: ByteBPE, column: pa.Array) -> pa.Array:
        rows = [bpe.encode(t) if t else [] for t in column.to_pylist()]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.fromiter(chain.from_iterable(rows), np.int64, int(ends[-1]))
        at = np.concatenate([[0], np.cumsum(bpe.offsets[flat + 1] - bpe.offsets[flat])])[ends]
        data = bpe.decode_bytes(flat).tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
        return pa.StructArray.from_arrays([ids, pa.array(texts, pa.string())], ["ids", "decoded"])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for texts in pieces(columns):
            yield coded(bpe, texts)

    return docs.withColumn(into, arrow_column(run, CODED)(F.col(text)))


def digests(coded: str = "coded") -> list:
    """Columns n_tokens, ids_sha256 and decoded_sha256 of what encode_decode() found."""
    ids = F.col(f"{coded}.ids")
    return [F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col(f"{coded}.decoded"), 256).alias("decoded_sha256")]


def op5_bpe_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path()).select("doc_id", *digests())


QUERIES = {"op5_bpe_backtrack": op5_bpe_backtrack}
