"""Declared schemas of stored tables, by version; reads widen what older versions wrote.

A version lists the columns it adds, each with the value that older rows have
there. A reader asks for the last version: files that lack a column give null,
which is filled where the column was declared with a value. So a folder of files
of several versions is one table and nothing is rewritten; migrate() rewrites
only if asked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.expressions import r6
from tidewheel.operators import store
from tidewheel.operators.oracle import with_
from tidewheel.sources.adapter import macro_series

#: table: versions of (column, type, value of rows written before), in order; a null value leaves null.
VERSIONS: dict[str, list[list[tuple[str, str, str | None]]]] = {
    "macro_series": [
        [("series", "string", None), ("date", "date", None), ("value", "double", None), ("source", "string", None)],
        [("series_name", "string", "''"), ("frequency", "string", "''"), ("units", "string", "''"), ("realtime_start", "string", "''"), ("realtime_end", "string", "''"), ("raw_json", "string", "'{}'"), ("quality_status", "string", "'ok'")],
    ],
    "prices_intraday": [
        [(c, "string", None) for c in ("symbol", "timeframe")] + [("ts", "timestamp", None)] + [(c, "double", None) for c in ("open", "high", "low", "close", "volume")] + [("source", "string", None)],
        [("vwap", "double", None)],
    ],
    "stock_scores": [
        [("score_date", "date", None), ("symbol", "string", None), ("rank", "int", None), ("score", "double", None)],
        [("components_json", "string", "'{}'")],
    ],
    "events": [
        [("symbol", "string", None), ("sector", "string", None), ("event_date", "date", None), ("event_type", "string", None), ("headline", "string", None), ("source", "string", None), ("url", "string", None)],
        [("event_time", "string", None), ("source_event_id", "string", None), ("effective_date", "string", None), ("processed_at", "string", None), ("fetched_at", "string", None), ("actual", "double", None), ("estimate", "double", None), ("surprise", "double", None), ("fiscal_period", "string", None), ("raw_json", "string", "'{}'"), ("quality_status", "string", "'ok'")],
    ],
}


def columns(table: str, version: int | None = None) -> list[tuple[str, str, str | None]]:
    versions = VERSIONS[table]
    return [c for v in versions[: version or len(versions)] for c in v]


def declared(table: str, version: int | None = None) -> str:
    """The schema of a version, the last one if none is given."""
    return ", ".join(f"{name} {kind}" for name, kind, _ in columns(table, version))


def widen(df: DataFrame, table: str) -> DataFrame:
    """df with the last version's columns and types; what it lacks has its declared value, other columns are left out."""
    have = {c.lower() for c in df.columns}
    value = lambda name, kind, default: (F.col(name) if name.lower() in have else F.lit(None)).cast(kind)
    return df.select(*((value(n, k, d) if d is None else F.coalesce(value(n, k, d), F.expr(d).cast(k))).alias(n) for n, k, d in columns(table)))


def read(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A folder of files of any versions as the last one."""
    return widen(spark.read.schema(declared(table)).parquet(path), table)


def version_of(spark: SparkSession, table: str, path: str) -> int:
    """The last version that a folder's files, taken together, have all columns of; 0 if they lack some of the first."""
    have = {c.lower() for c in spark.read.option("mergeSchema", True).parquet(path).columns}
    versions = VERSIONS[table]
    return next((v for v in range(len(versions), 0, -1) if {c[0] for c in columns(table, v)} <= have), 0)


def migrate(spark: SparkSession, table: str, path: str, out: str) -> None:
    """The folder rewritten in the last version; to run it again changes nothing."""
    read(spark, table, path).write.mode("overwrite").parquet(out)


def two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro observations written half by the first version and half by the last, read as one table."""
    path = f"{store.shared_folder(spark)}/market/versions-{uuid.uuid4().hex}"
    rows = macro_series(spark, sf_dir).withColumn("source", F.lit("feed"))
    old = F.year("date") % 2 == 0
    rows.filter(old).select(*(c[0] for c in columns("macro_series", 1))).write.parquet(path)
    widen(rows.filter(~old).withColumn("units", F.lit("index")), "macro_series").write.mode("append").parquet(path)
    return read(spark, "macro_series", path).selectExpr("series", "date", r6("value"), "source", "series_name", "frequency", "units", "raw_json", "quality_status")


QUERIES = {"k11_two_versions": two_versions}
ORACLE = {"k11_two_versions": with_("SELECT series, date, " + r6("value") + ", 'feed' AS source, '' AS series_name, CASE WHEN year(date) % 2 = 0 THEN '' ELSE frequency END AS frequency, CASE WHEN year(date) % 2 = 0 THEN '' ELSE 'index' END AS units, '{}' AS raw_json, 'ok' AS quality_status FROM x_macro")}
