"""Operator 7: secrets, told apart by how widely the corpus owns them.

Texts are scanned once. Each candidate's hash is then counted by distinct
repository and distinct owner over the whole corpus. A value that common_owners
or more have, or common_repositories or more hold, is a copied example; one of
few owners that looks random is taken as live, unless it spells out that it is a
placeholder.

Rows of one hash are reduced to distinct owners before they meet. Counts go back
to the spans by a join salted with the row: each count is repeated SALTS times,
so a value that a third of the corpus repeats is spread over as many tasks.

Base kinds (assign, access, hex) keep every span. The method adds kinds for
private keys, provider tokens, web tokens and credentials in URLs.

Defined cases: a null text is empty; null repository or owner counts as one
unknown owner; repeated rows are scanned each for itself and share owners, so
they do not make a value common; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, spare, table, thrifty

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A text without any of these has no assignment; the search is far cheaper than the pattern.
ASSIGN_WORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
#: kind, a literal that every match contains, pattern, the group that holds the value
ADDED = (
    ("provider", "_", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,})"), 0),
    ("provider", "xox", re.compile(r"\bxox[abprs][-_][A-Za-z0-9-]{10,}"), 0),
    ("web_token", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), 0),
    ("url", "://", re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]+://[^\s:/@]+:([^\s:/@]{3,})@"), 1),
)
#: The first and last line of a private key; key_blocks() pairs them.
KEY_EDGE = re.compile(r"-----(?:(BEGIN)|END) (?:[A-Z]+ )*PRIVATE KEY-----")
KIND_ORDER = {k: i for i, k in enumerate((*BASE_KINDS, "private_key", *(x[0] for x in ADDED)))}
#: Words count only between non-letters: "latest" and "Contest" are no placeholders.
PLACEHOLDER = re.compile(r"(?<![a-z])(?:example|sample|changeme|your|dummy|test|placeholder|\d?1234567\d*)(?![a-z])|xxxx|\*\*\*\*|(.)\1{5}", re.I)

SALTS = 32
SPAN = "struct<kind:string,kind_order:int,begin:int,end:int,value_hash:string,entropy:double,placeholder:boolean>"


def placeholder(kind: str, value: str) -> bool:
    """Whether a value reads as an example; whole key blocks contain any short word by chance."""
    return kind != "private_key" and bool(PLACEHOLDER.search(value))


def entropy(value: str) -> float:
    """Bits a character of the value's own letter frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans from a key's first line to the next last line, in one walk: a line that is never closed costs no second look."""
    begin = None
    for m in KEY_EDGE.finditer(text):
        if m[1] and begin is None:
            begin = m.start()
        elif not m[1] and begin is not None:
            yield begin, m.end()
            begin = None


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, value) by begin, then kind; positions are code points, end exclusive."""
    out = []
    if ASSIGN_WORDS.search(text):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    if "PRIVATE KEY" in text:
        out += [("private_key", a, b, text[a:b]) for a, b in key_blocks(text)]
    for kind, literal, pattern, group in ADDED:
        if literal in text:
            out += [(kind, m.start(), m.end(), m[group]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KIND_ORDER[x[0]]))


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The kept columns and `found`, the array of candidate spans, of every row."""
    fields = docs.select(*keep).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", found array<{SPAN}>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("kind_order", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("value_hash", pa.string()), ("entropy", pa.float64()), ("placeholder", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            rows = [
                [
                    {"kind": k, "kind_order": KIND_ORDER[k], "begin": a, "end": b, "value_hash": hashlib.sha256(v.encode()).hexdigest()[:32], "entropy": entropy(v), "placeholder": placeholder(k, v)}
                    for k, a, b, v in find(t or "")
                ]
                for t in batch.column(len(keep)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, arrow)], [*keep, "found"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(thrifty(run), schema)


def ownership(found: DataFrame, *, repository, owner) -> DataFrame:
    """(value_hash, n_repositories, n_owners, n_uses) of every candidate value of the corpus."""
    each = found.select(F.explode("found.value_hash").alias("value_hash"), F.coalesce(repository.cast("string"), F.lit("")).alias("r"), F.coalesce(owner.cast("string"), F.lit("")).alias("o"))
    uses = each.groupBy("value_hash", "r", "o").agg(F.count(F.lit(1)).alias("n"))
    return uses.groupBy("value_hash").agg(F.count_distinct("r").alias("n_repositories"), F.count_distinct("o").alias("n_owners"), F.sum("n").alias("n_uses"))


def classify(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id", "source", "lang"),
    repository=None,
    owner=None,
    common_owners: int = 3,
    common_repositories: int = 6,
    least_entropy: float = 2.5,
) -> DataFrame:
    """Every row's spans with a verdict: the kept columns, `row_no`, and `found` with n_owners and verdict.

    verdict: `example` if common_owners or more owners or common_repositories or
    more repositories hold the value, or if it reads as a placeholder; else `live`
    if its entropy is least_entropy or more; else `weak`. owner and repository
    default to the source, and to source with language.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    found = materialise(scan(docs, text=text, keep=keep).withColumn("row_no", F.monotonically_increasing_id()), "secrets")
    counts = ownership(found, repository=repository, owner=owner)
    salt = F.pmod(F.col("row_no"), F.lit(SALTS))
    spans = found.select("row_no", salt.alias("salt"), F.explode("found").alias("s")).select("row_no", "salt", "s.*")
    spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    common = (F.col("n_owners") >= common_owners) | (F.col("n_repositories") >= common_repositories)
    verdict = F.when(common | F.col("placeholder"), "example").when((F.col("entropy") >= least_entropy) | (F.col("kind") == "private_key"), "live").otherwise("weak")
    judged = spans.join(spread, ["value_hash", "salt"]).withColumn("verdict", verdict)
    again = judged.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("begin", "kind_order", "end", "kind", "value_hash", "entropy", "n_repositories", "n_owners", "verdict"))).alias("spans"))
    return found.drop("found").join(again, "row_no", "left").withColumn("spans", F.coalesce("spans", F.array().cast(again.schema["spans"].dataType)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classify(table(spark, sf_dir, "documents"))
    line = lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    with_verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return judged.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS)), line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        with_verdict("live").alias("n_live"),
        with_verdict("example").alias("n_example"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_owners"])), F.lit(0)).cast("long").alias("most_owners"),
    )


def redact(docs: DataFrame, *, text: str = "text", key: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span that classify() calls live replaced by `mark`; rows and columns stay.

    Only spans of live values travel, by 128 bits of key and text with null marks,
    so that rows which repeat a key, or have none, still get their own. A null text
    stays null.
    """
    name, live, done_ = spare(docs, "__key"), spare(docs, "__live"), spare(docs, "__done")
    parts = [x for c in (F.col(key).cast("string"), F.col(text)) for x in (c.isNull(), c)]
    keyed = docs.withColumn(name, F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b")))
    judged = classify(keyed, text=text, keep=(name, "source", "lang"))
    spans = judged.select(name, F.transform(F.filter("spans", lambda s: s["verdict"] == "live"), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))).alias(live))
    spans = spans.filter(F.size(live) > 0).dropDuplicates([name])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done, span):
        ahead = F.col(text).substr(done["at"] + 1, span["begin"] - done["at"])
        return F.when(span["begin"] >= done["at"], F.struct(span["end"].alias("at"), F.concat(done["out"], ahead, F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(done["at"], span["end"]).alias("at"), done["out"].alias("out"))
        )

    joined = keyed.join(spans, name, "left").withColumn(done_, F.aggregate(live, start, step))
    rest = F.col(text).substr(F.col(f"{done_}.at") + 1, F.length(text))
    return joined.select(*(F.when(F.col(live).isNull(), F.col(text)).otherwise(F.concat(f"{done_}.out", rest)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns))


QUERIES = {"op7_secret_scan": op7_secret_scan}
