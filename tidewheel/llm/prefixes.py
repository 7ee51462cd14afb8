"""Operator 11: the trie of conversation prefixes.

Each conversation is a path: the digest of its first d turns is the digest of
its first d - 1 chained with the d-th turn's. Every prefix is a row; those of
equal depth and digest are one node, whose members are the conversations that
begin with it. The least member is the node's representative.

The nodes that one conversation represents are the end of its path, so a node's
ancestors are rows of its representative. Each node is exploded to all of them;
nodes of one representative are first summed from the deepest up, so that this
gives a row for each prefix and not one for each pair. Sums, counts and minima
are reduced before every shuffle, so a turn that a third of all conversations
share is no hot group; joins meet on keys of one row, but for the lookup of the
parent's representative, which Spark splits by itself if children are skewed.

A conversation may have any number of turns: they are numbered in chunks of turn
values, and digests are chained in segments of SEGMENT turns and over the ends
of segments, so neither one task nor memory holds a conversation. Lists of ids
are put together in stretches of IDS and hashed as a stream.

Defined cases: a null role or text is empty; null turns come first, equal turns
go by role, then text; repeated rows are repeated turns; rows without a
conversation belong to none; other columns are not read; an empty table has no
nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, thrifty

CHUNK = 64
SEGMENT = 1024
IDS = 4096
#: Digest of no turns.
ROOT = bytes(32)
SPACE = r"[\x20\x09-\x0D]+"


def numbered(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, chunk, no, turn_digest, words) of every turn; no counts the turns before it in its chunk of turn values."""
    turns = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))  # the length parts role from text
    words = F.size(F.filter(F.split("text", SPACE), lambda w: w != "")).cast("long")
    return turns.withColumn("no", F.row_number().over(inside) - 1).select("conv_id", "chunk", "no", F.unhex(F.sha2(whole, 256)).alias("turn_digest"), words.alias("words"))


def paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, turn_digest, words, total) of every turn, (conv_id, total) of every conversation) as they are."""
    chunks = turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("conv_id").orderBy("chunk")
    placed = chunks.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    convs = chunks.groupBy("conv_id").agg(F.sum("n").alias("total"))
    rows = turns.join(placed.join(convs, "conv_id").drop("n"), ["conv_id", "chunk"])
    return rows.select("conv_id", (F.col("before") + F.col("no") + 1).alias("depth"), "turn_digest", "words", "total"), convs


def rebuilt(rows: DataFrame, convs: DataFrame, donor: Column, borrowed: Column, *, most: int) -> tuple[DataFrame, DataFrame]:
    """paths() of conversations whose first `borrowed` (at most `most`) turns are those of `donor`, and whose own come after.

    donor and borrowed are columns of conv_id; a donor lends only what it has.
    """
    lengths = convs.select(F.col("conv_id").alias("donor"), F.col("total").alias("theirs"))
    asked = convs.withColumns({"donor": donor, "h": borrowed.cast("long")}).join(lengths, "donor", "left").withColumn("got", F.least("h", F.coalesce("theirs", F.lit(0))))
    asked = materialise(asked.withColumn("own", F.greatest(F.col("total") - F.col("h"), F.lit(0))).select("conv_id", "donor", "h", "got", (F.col("got") + F.col("own")).alias("total")), "rebuilt")
    kept = rows.drop("total").join(asked, "conv_id").filter("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("got")).alias("depth"), "turn_digest", "words", "total")
    heads = rows.filter(F.col("depth") <= most).select(F.col("conv_id").alias("donor"), "depth", "turn_digest", "words")
    lent = asked.join(heads, "donor").filter("depth <= got").select("conv_id", "depth", "turn_digest", "words", "total")
    return kept.union(lent), asked.select("conv_id", "total")


def _chained(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """rows with `out`, each digest chained to that of the row before, and `before`; a stretch of equal keys starts anew.

    rows must be partitioned by the keys and sorted; no group is held.
    """
    names = rows.columns
    places = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, ROOT
        for batch in batches:
            found, before = [], []
            for *key, v in zip(*(batch.column(p).to_pylist() for p in places), batch.column(names.index(value)).to_pylist(), strict=True):
                if key != now:
                    now, digest = key, ROOT
                before.append(digest)
                digest = hashlib.sha256(digest + v).digest()
                found.append(digest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()), pa.array(before, pa.binary())], [*names, out, "before"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(thrifty(run), f"{schema}, {out} binary, before binary")


def prefixes(rows: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, depth, segment, digest, parent, words, last) of every prefix but the empty one; parent is the digest one turn shorter.

    A segment's chain is its own; the digest of a prefix joins it with `carry`, the
    digest of all segments before, so only the segments' ends are chained in one place.
    """
    cut = rows.withColumn("segment", F.floor((F.col("depth") - 1) / segment))
    cut = cut.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "depth")
    local = materialise(_chained(cut, ["conv_id", "segment"], "turn_digest", "local").drop("turn_digest"), "chains")
    ends = local.filter(F.col("depth") % segment == 0).select("conv_id", (F.col("segment") + 1).alias("segment"), F.col("local").alias("end"))
    carried = _chained(ends.repartition("conv_id").sortWithinPartitions("conv_id", "segment"), ["conv_id"], "end", "carry").select("conv_id", "segment", "carry")
    both = local.filter("segment = 0").withColumn("carry", F.lit(ROOT)).unionByName(local.filter("segment > 0").join(carried, ["conv_id", "segment"]))
    joined = lambda x: F.unhex(F.sha2(F.concat("carry", x), 256))
    at_start = (F.col("depth") - 1) % segment == 0
    return both.select("conv_id", "depth", "segment", joined("local").alias("digest"), F.when(at_start, F.col("carry")).otherwise(joined("before")).alias("parent"), "words", (F.col("depth") == F.col("total")).alias("last"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of nodes (depth, digest, conv_id): the hash of their ascending ids, comma-joined.

    Ids are joined in stretches of IDS values, which are hashed in order as they
    come; so memory is bounded however many conversations end in a node.
    """
    part = ends.groupBy("depth", "digest", F.floor(F.col("conv_id") / IDS).alias("stretch")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for depth, digest, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (depth, digest) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (depth, digest), hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield out(done)
        if now:
            yield out([(*now, state.hexdigest())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        depth, digest, found = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(digest, pa.binary()), pa.array(found, pa.string())], ["depth", "digest", "ends_sha256"])

    sorted_ = part.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "stretch").select("depth", "digest", "stretch", "ids")
    return sorted_.mapInArrow(thrifty(run), "depth long, digest binary, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """One row for each node: conv_id (the representative), depth, digest, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows and convs are those of paths() or rebuilt(); conversations without turns are members of the root.
    """
    every = materialise(prefixes(rows, segment=segment), "prefixes")
    nodes = every.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("words").alias("words"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"))
    nodes = materialise(nodes.union(root), "nodes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(below, ["depth", "digest"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # what each node adds to its own and every subtree above it
    adds = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    owned = adds.filter("depth > 0")
    chains = owned.select("conv_id").distinct()
    ancestors = every.join(chains, "conv_id", "left_semi").join(owned, ["conv_id", "depth"], "left").select("conv_id", "depth", "segment", "digest", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    from_below = summed_up(ancestors).groupBy("depth", "digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    of_root = adds.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves")).select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), "saved_tokens", "n_leaves")
    ended = every.filter("last").select("depth", "digest", "conv_id").union(convs.filter("total = 0").select(F.lit(0).cast("long"), F.lit(ROOT), "conv_id"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(from_below.union(of_root), ["depth", "digest"]).join(ends_digest(ended), ["depth", "digest"], "left").join(above, ["depth", "parent"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return full.select("conv_id", "depth", "digest", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def summed_up(ancestors: DataFrame) -> DataFrame:
    """(depth, digest, saved, leaf) with the sums from the deepest prefix of the conversation up to each, by segments."""
    deeper = Window.partitionBy("conv_id", "segment").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = ancestors.groupBy("conv_id", "segment").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    later = Window.partitionBy("conv_id").orderBy(F.col("segment").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = parts.select("conv_id", "segment", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"))
    inside = ancestors.withColumns({"saved": F.sum("saved").over(deeper), "leaf": F.sum("leaf").over(deeper)})
    return inside.join(after, ["conv_id", "segment"]).select("depth", "digest", (F.col("saved") + F.col("s")).alias("saved"), (F.col("leaf") + F.col("l")).alias("leaf"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, convs = paths(materialise(numbered(table(spark, sf_dir, "conversations")), "turns"))
    conv = F.col("conv_id")
    rows, convs = rebuilt(rows, convs, conv - conv % 20, F.crc32(conv.cast("string")) % 4, most=3)
    return trie(rows, convs).drop("digest")


_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
_CRC = "list_transform(range(len(CAST(conv_id AS VARCHAR))), lambda k: [ord(substr(CAST(conv_id AS VARCHAR), k + 1, 1)), -1, -1, -1, -1, -1, -1, -1, -1])"

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE = {
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS donor,
        CAST(xor(list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten({_CRC})]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS BIGINT) AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, no, role, text FROM c JOIN t ON t.conv_id = donor AND no <= h UNION ALL SELECT c.conv_id, 1, no, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND no > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, sha256(CAST(list({{'r': role, 't': text}}) OVER w AS VARCHAR)) || '-' || row_number() OVER w AS node, CAST({_WORDS} AS BIGINT) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, no ROWS UNBOUNDED PRECEDING)),
e AS (SELECT conv_id, depth, node, words, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM d
      UNION ALL SELECT conv_id, 0, '', 0, NULL, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last) AS ends FROM e GROUP BY ALL),
k AS (SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.parent = n.node) AS n_children FROM n),
p AS (SELECT DISTINCT a.node AS top, b.node FROM e AS a JOIN e AS b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
s AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM p JOIN k USING (node) GROUP BY top)
SELECT k.conv_id, k.depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM k JOIN s ON s.top = k.node LEFT JOIN n AS up ON up.node = k.parent
"""
}
