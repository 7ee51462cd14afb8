"""Operator 8: quality rules with thresholds from mergeable quantile sketches.

Text measures are DataFrame expressions, one pass over each row and no shuffle.
Each measure is an integer; its sketch is a histogram with relative buckets (the
seven leading bits), so counts of buckets add up exactly however the rows were
partitioned, and a quantile is right to one part in 64. Sketches are kept by
language and source and merged upwards to the language and to the whole corpus.
The hot source is only ever some thousand counters when it meets. Verdicts come
from a join of the measures with the fences.

The fences of a level lie REACH * (q75 - q25 + slack) below q25 and above q75, so
only far outliers of a language and source fail: what all texts of a source do is
not held against one. The fewer rows a level has, the more it leans on the wider
one: a fence is the mean of its own, weighted by its rows, and the wider level's,
weighted by `prior` rows. So no size switches from one rule to another.

Defined cases: a null text is empty and fails the base rules; null language or
source is a group of its own; repeated rows count each; other columns are not
read. Words are [^\\x20\\x09-\\x0D]+.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

PRIOR = 100
REACH = 6
BITS = 7
#: measure, slack: what the spread is widened by, so that groups that hardly vary have no narrow fences
MEASURES = (("word_len_x100", 30), ("symbols_x1000", 20), ("dup_lines_x1000", 100), ("repeats_x1000", 70))


def measures(text):
    """Column expressions of the base counts of a text column: words, and what is needed of them."""
    text = F.coalesce(text, F.lit(""))
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    chars = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return split, lines, chars, symbols


def base_counts(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    split, lines, chars, symbols = measures(F.col("__text"))
    counted = docs.select(*keep, F.col(text).alias("__text")).select(
        *keep,
        split.alias("w"),
        lines.alias("l"),
        chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
    )
    # every 3-word window as (hash of its words, position), sorted: equal windows stand side by side
    window = F.expr("transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i))")
    sized = counted.select(*keep, F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), F.when(F.size("w") >= 3, F.sort_array(window)).alias("s"))
    twice = F.expr("sort_array(filter(transform(s, (x, k) -> IF((k > 0 AND s[k - 1].h = x.h) OR (k < size(s) - 1 AND s[k + 1].h = x.h), x.i, -1)), i -> i >= 0))")
    marked = sized.withColumn("t", twice).drop("s")
    # a window covers three words; where the next one begins sooner, only up to it
    covered = F.expr("aggregate(t, struct(-3 AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n), a -> a.n)")
    return marked.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("t")


def base_failed():
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def ratios(counted: DataFrame) -> DataFrame:
    """counted with one integer column for each of MEASURES."""
    per = lambda n, scale, of="n_words": F.expr(f"CASE WHEN {of} > 0 THEN ({n} * {scale}) DIV {of} ELSE 0 END")
    return counted.withColumns({"word_len_x100": per("word_chars", 100), "symbols_x1000": per("n_symbols", 1000), "dup_lines_x1000": per("n_dup_lines", 1000, "n_lines"), "repeats_x1000": per("n_repeat_words", 1000)})


def bucket(value: str) -> str:
    """SQL of the sketch's bucket: the least integer with the same BITS leading bits."""
    shift = f"greatest(length(bin({value})) - {BITS}, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def sketch(rated: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): mergeable by adding n."""
    names = ", ".join(f"'{m}', {m}" for m, _ in MEASURES)
    long = rated.filter(~base_failed()).select("lang", "source", F.expr(f"stack({len(MEASURES)}, {names}) AS (measure, value)"))
    return long.groupBy("lang", "source", "measure", F.expr(bucket("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, measure, rows, q25, q75) of merged sketches; a sketch has at most 64 buckets for each power of two."""
    groups = sketches.groupBy(*by, "measure").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))

    def at(percent: int):
        reached = F.expr(f"aggregate(b, struct(0L AS n, CAST(NULL AS BIGINT) AS q), (a, x) -> struct(a.n + x.n AS n, coalesce(a.q, IF((a.n + x.n) * 100 >= rows * {percent}, x.bucket, NULL)) AS q), a -> a.q)")
        return reached.alias(f"q{percent}")

    return groups.select(*by, "measure", "rows", at(25), at(75))


def fences(sketches: DataFrame, *by: str, reach: int = REACH) -> DataFrame:
    """One row a group: the rows behind it and for each measure the lowest and the highest value that passes."""
    slack = F.expr("CASE measure " + " ".join(f"WHEN '{m}' THEN {s}" for m, s in MEASURES) + " END")
    far = F.lit(reach) * (F.col("q75") - F.col("q25") + slack)
    level = quantiles(sketches, *by).withColumns({"low": F.greatest(F.col("q25") - far, F.lit(0)), "high": F.col("q75") + far})
    each = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m, _ in MEASURES for side in SIDES]
    return level.groupBy(*by).agg(F.max("rows").alias("rows"), *each)


SIDES = ("low", "high")


def judge(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source"), prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """Every row's counts with base_failed and kept. keep must hold lang and source."""
    rated = materialise(ratios(base_counts(docs, text=text, keep=keep)), "quality")
    sketches = materialise(sketch(rated), "sketches")
    named = lambda df, tag: df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))
    s, g, a = (named(fences(merge(sketches, *by) if len(by) < 2 else sketches, *by, reach=reach), tag) for tag, by in (("s", ("lang", "source")), ("g", ("lang",)), ("a", ())))
    joined = rated.join(s, F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")), "left")
    joined = joined.join(g, F.col("lang").eqNullSafe(F.col("g_lang")), "left").join(F.broadcast(a), F.lit(True), "left")  # one row
    passes = F.lit(True)
    for m, _ in MEASURES:
        low, high = (F.expr(leaning(leaning(f"a_{m}_{side}", f"g_{m}_{side}", "g_rows", prior), f"s_{m}_{side}", "s_rows", prior)) for side in SIDES)
        passes = passes & F.coalesce(F.col(m).between(low, high), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passes).select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def leaning(wider: str, own: str, rows: str, prior: int, div: str = "DIV") -> str:
    """SQL of a level's fence: its own by its rows, and the wider level's by `prior` rows."""
    return f"(({rows} * {own} + {prior} * {wider}) {div} ({rows} + {prior}))"


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("lang", "source")


QUERIES = {"op8_adaptive_quality": op8_adaptive_quality}


def _oracle() -> str:
    space = r"[\x20\x09-\x0D]+"
    shift = lambda v: f"greatest(length(ltrim(bin({v}), '0')) - {BITS}, 0)"
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS value FROM r WHERE NOT base_failed" for m, _ in MEASURES)
    slack = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s}" for m, s in MEASURES) + " END"

    far = f"{REACH} * (q75 - q25 + {slack})"

    def level(name: str, by: str) -> str:
        comma = by + "," if by else ""
        join = " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in [*by.replace(" ", "").split(","), "measure"] if c)
        return f"""
{name}_b AS (SELECT {comma} measure, bucket, count(*) AS n FROM v GROUP BY {comma} measure, bucket),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {comma} measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {comma} measure) AS total FROM {name}_b),
{name}_q AS (SELECT {comma} measure, max(total) AS total, min(bucket) FILTER (WHERE upto * 100 >= total * 25) AS q25, min(bucket) FILTER (WHERE upto * 100 >= total * 75) AS q75 FROM {name}_c GROUP BY {comma} measure),
{name} AS (SELECT {comma} max(total) AS rows, {", ".join(f"max(greatest(q25 - {far}, 0)) FILTER (WHERE measure = '{m}') AS {m}_low, max(q75 + {far}) FILTER (WHERE measure = '{m}') AS {m}_high" for m, _ in MEASURES)} FROM {name}_q {("GROUP BY " + by) if by else ""})"""

    fence = lambda m, side: leaning(leaning(f"a.{m}_{side}", f"g.{m}_{side}", "g.rows", PRIOR, "//"), f"s.{m}_{side}", "s.rows", PRIOR, "//")
    passes = " AND ".join(f"coalesce(r.{m} BETWEEN {fence(m, 'low')} AND {fence(m, 'high')}, true)" for m, _ in MEASURES)
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, lang, source, x, list_filter(regexp_split_to_array(x, '{space}'), lambda y: y <> '') AS w,
             list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
k AS (SELECT *, len(w) AS n_words, length(regexp_replace(x, '{space}', '', 'g')) AS word_chars,
             length(x) - length(translate(x, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             row_number() OVER () AS u FROM w),
p AS (SELECT u, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM k, unnest(range(1, n_words - 1)) AS r(i)),
twice AS (SELECT u, i FROM (SELECT *, count(*) OVER (PARTITION BY u, g) AS c FROM p) WHERE c > 1),
cover AS (SELECT u, count(DISTINCT i + d) AS n FROM twice, unnest([0, 1, 2]) AS r(d) GROUP BY u),
c AS (SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM k LEFT JOIN cover USING (u)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_len_x100,
             CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols_x1000,
             CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines_x1000,
             CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats_x1000 FROM c),
v AS (SELECT *, (value >> {shift("value")}) << {shift("value")} AS bucket FROM ({values})),
{level("s", "lang, source")},
{level("g", "lang")},
{level("a", "")}
SELECT r.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {passes} AS kept
FROM r LEFT JOIN s ON r.lang IS NOT DISTINCT FROM s.lang AND r.source IS NOT DISTINCT FROM s.source
LEFT JOIN g ON r.lang IS NOT DISTINCT FROM g.lang LEFT JOIN a ON true
"""


ORACLE = {"op8_adaptive_quality": _oracle()}
