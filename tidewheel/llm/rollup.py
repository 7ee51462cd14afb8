"""Operator 10: token counts as delta-maintained rollups.

A change batch holds signed counts: an insert adds a document's tokens, a delete
takes back what it had, a revision does both. Summed by source, language and
tokenizer version a batch is a few rows, whatever the size of the corpus behind
it, and a third of all rows in one source meets as partial sums.

A store is a folder with one sub-folder for each committed batch. Committing
writes the batch's sums into an attempt folder of its own and then renames that
to the batch's name. The first rename wins, and what a later writer renames is
never read, so committing twice, two writers at once, or a lost executor change
nothing; attempts that never came to their rename are not seen. Totals are the sums over marked batches; compact() folds them into one
batch that lists what it holds; it is run by one writer at a time.

Defined cases: null text has no tokens; null source or language is a group of
its own; repeated rows count each; a delete or revision of something unknown is
the caller's signed count like any other; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, rans
from .common import arrow_column, materialise, new_path, pieces, table

GROUP = ("source", "lang", "version")
DELTA = "source string, lang string, version string, d_docs long, d_tokens long"

#: Tokenizer versions of the query: white-space words, and runs of letters, digits or symbols.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]"}


def by_tokenizer(path: str, kind: str) -> Callable[[Column], Column]:
    """A version that counts the tokens of a tokenizer file: `bytes` for byte-level BPE, `words` for the word tokenizer."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces(columns):
            if kind == "words":
                _, edges = rans.load(path).encode(texts, 0)
                yield pa.array(np.diff(edges) - 1)  # without the end id
            else:
                yield pa.array([len(bpe.load(path).encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return arrow_column(run, "long")


def tokenizers() -> dict[str, Callable[[Column], Column]]:
    """Versions by the two tokenizer files that operators 5 and 9 encode with; several times the cost of VERSIONS."""
    return {"byte-bpe-50k": by_tokenizer(bpe.vocabulary_path(), "bytes"), "word-bpe-49k": by_tokenizer(rans.vocabulary_path(), "words")}


def count(text: Column, version: str | Callable[[Column], Column]) -> Column:
    """Tokens of a text: matches of a pattern, or what a version's own function counts."""
    found = F.regexp_count(text, F.lit(version)) if isinstance(version, str) else version(text)
    return F.coalesce(found, F.lit(0)).cast("long")


def counted(docs: DataFrame, *, text: Column | str = "text", versions: dict[str, str | Callable[[Column], Column]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source, lang, version, n_tokens) of every row and version, with the kept columns."""
    versions = versions or VERSIONS
    column = F.col(text) if isinstance(text, str) else text
    each = F.array(*(F.struct(F.lit(v).alias("version"), count(column, p).alias("n_tokens")) for v, p in versions.items()))
    return docs.select("source", "lang", *keep, F.explode(each).alias("c")).select("source", "lang", "c.version", "c.n_tokens", *keep)


def delta(changes: DataFrame) -> DataFrame:
    """Sums of a change batch: rows (source, lang, version, n_tokens, sign, docs_sign)."""
    return changes.groupBy(*GROUP).agg(F.sum("docs_sign").cast("long").alias("d_docs"), F.sum(F.col("n_tokens") * F.col("sign")).cast("long").alias("d_tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"sign": F.lit(1), "docs_sign": F.lit(1)})


def deletes(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"sign": F.lit(-1), "docs_sign": F.lit(-1)})


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts taken back, new ones added; the number of documents stays."""
    return old.withColumns({"sign": F.lit(-1), "docs_sign": F.lit(0)}).union(new.withColumns({"sign": F.lit(1), "docs_sign": F.lit(0)}))


class RollupStore:
    """Committed batches of sums in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = None

    def _file_system(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _exists(self, *parts: str) -> bool:
        fs, path = self._file_system()
        return fs.exists(path("/".join([self.path, *parts])))

    def batches(self) -> list[str]:
        """Committed batches, without those that a compaction holds."""
        fs, path = self._file_system()
        if not fs.exists(path(self.path)):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path(self.path)))
        done = [n for n in names if n.startswith("batch=") and self._exists(n, "_SUCCESS")]
        folded = {n for c in done if c.startswith("batch=compacted-") for n in self._held(c)}
        return [n for n in done if n not in folded]

    def _held(self, name: str) -> list[str]:
        return [r[0] for r in self.spark.read.parquet(f"{self.path}/{name}/held").collect()]

    def known(self, batch: str) -> bool:
        name = f"batch={batch}"
        if self._exists(name, "_SUCCESS"):
            return True
        return any(name in self._held(c) for c in self.batches() if c.startswith("batch=compacted-"))

    def commit(self, batch: str, sums: DataFrame) -> bool:
        """Write a batch's sums once; False if it was committed before."""
        if self.known(batch):
            return False
        return self._publish(f"batch={batch}", {"sums": sums.select(*GROUP, "d_docs", "d_tokens")})

    def _publish(self, name: str, parts: dict[str, DataFrame]) -> bool:
        """Write an attempt, then rename it; True if this attempt became `name`.

        A rename onto a folder that is there fails or lands inside it, by file
        system, so the winner is told by its own mark.
        """
        attempt = f"attempt-{uuid.uuid4().hex}"
        for part, rows in parts.items():
            rows.write.parquet(f"{self.path}/{attempt}/{part}")
        fs, path = self._file_system()
        for mark in (attempt, "_SUCCESS"):
            fs.create(path(f"{self.path}/{attempt}/{mark}"), True).close()
        fs.rename(path(f"{self.path}/{attempt}"), path(f"{self.path}/{name}"))
        if self._exists(name, attempt, "_SUCCESS") or not self._exists(name, attempt):
            for left in (f"{name}/{attempt}", attempt):
                fs.delete(path(f"{self.path}/{left}"), True)
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        paths = [f"{self.path}/{n}/sums" for n in self.batches()]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))

    def compact(self, name: str) -> None:
        """Fold all committed batches into one; the old folders stay until they are removed."""
        held = self.batches()
        everything = {n for c in held for n in [c, *(self._held(c) if c.startswith("batch=compacted-") else [])]}
        sums = self.totals().select(*GROUP, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        names = self.spark.createDataFrame([(n,) for n in sorted(everything)], "name string")
        self._publish(f"batch=compacted-{name}", {"sums": sums.coalesce(1), "held": names.coalesce(1)})


def changes(docs: DataFrame, *, versions: dict | None = None) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens, revised, n_revised) of every row and version, counted in one pass.

    A text with repeated lines is revised to its distinct lines; n_revised is the
    count after that.
    """
    lines = F.split("text", "\n")
    known = docs.select("doc_id", "source", "lang", "text", (F.size(F.array_distinct(lines)) < F.size(lines)).alias("revised"))
    known = known.withColumn("clean", F.when(F.col("revised"), F.array_join(F.array_distinct(lines), "\n")))
    pairs = [F.struct(F.lit(v).alias("version"), count(F.col("text"), p).alias("n_tokens"), count(F.col("clean"), p).alias("n_clean")) for v, p in (versions or VERSIONS).items()]
    each = known.select("doc_id", "source", "lang", F.coalesce("revised", F.lit(False)).alias("revised"), F.array(*pairs).alias("c"))
    return each.select("doc_id", "source", "lang", "revised", F.explode("c").alias("c")).select("doc_id", "source", "lang", "revised", "c.version", "c.n_tokens", F.when(F.col("revised"), F.col("c.n_clean")).otherwise(F.col("c.n_tokens")).alias("n_revised"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents.

    All documents arrive; those with repeated lines are revised to the counts of
    their distinct lines; those labelled toxic are deleted; the revision is sent
    a second time, which changes nothing.
    """
    rows = materialise(changes(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")), "token-counts")
    labels = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    old, new = rows.select(*GROUP, "n_tokens"), rows.select(*GROUP, F.col("n_revised").alias("n_tokens"), "revised", "doc_id")
    store = RollupStore(spark, new_path(spark, "rollup"))
    store.commit("0001-load", delta(inserts(old)))
    revision = delta(revisions(rows.filter("revised").select(*GROUP, "n_tokens"), new.filter("revised").select(*GROUP, "n_tokens")))
    store.commit("0002-revise", revision)
    store.commit("0003-delete", delta(deletes(new.join(labels, "doc_id").select(*GROUP, "n_tokens"))))
    store.commit("0002-revise", revision)
    return store.totals()


QUERIES = {"op10_token_rollup": op10_token_rollup}


def _oracle() -> str:
    n = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"
    now = "array_to_string(list_distinct_ordered, chr(10))"
    each = " UNION ALL ".join(f"SELECT source, lang, '{v}' AS version, {n('x', p)} AS n FROM d WHERE NOT gone" for v, p in VERSIONS.items())
    all_groups = " UNION ALL ".join(f"SELECT DISTINCT source, lang, '{v}' AS version FROM documents" for v in VERSIONS)
    return f"""
WITH s AS (SELECT source, lang, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
o AS (SELECT source, lang, doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM s),
d AS (SELECT source, lang, {now} AS x, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone FROM o),
c AS ({each}),
g AS ({all_groups})
SELECT g.source, g.lang, g.version, CAST(count(c.n) AS BIGINT) AS n_docs, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n_tokens
FROM g LEFT JOIN c ON g.source IS NOT DISTINCT FROM c.source AND g.lang IS NOT DISTINCT FROM c.lang AND g.version = c.version
GROUP BY g.source, g.lang, g.version
"""


ORACLE = {"op10_token_rollup": _oracle()}
