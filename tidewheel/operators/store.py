"""Stored tables: derived once, upserts by key, replaced date partitions, appended runs, exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {
    "symbols": ["symbol"],
    "sector_map": ["sector"],
    "industry_map": ["industry", "sector"],
    "prices_daily": ["symbol", "date"],
    "prices_intraday": ["symbol", "ts", "timeframe"],
    "macro_series": ["series", "date"],
    "market_regime_scores": ["date"],
    "events": ["source", "source_event_id"],
}


#: Tables that market plans derive from.
SOURCES = ("region", "nation", "supplier", "part", "lineitem", "orders", "events")
_STORED: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a cluster it must be named, a local one is set only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """What the source tables of a folder are now: name, bytes and time of each."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for name in SOURCES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        if fs.exists(path):
            out.append((name, fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return (sf_dir, *out)


def stored_folder(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The folder of what is derived as `name` of the tables in sf_dir, written at its first use.

    A session writes it anew if a source table has changed or the folder is gone.
    """
    key = (spark.sparkContext.applicationId, name, stamp(spark, sf_dir))
    path = _STORED.get(key)
    if path is not None:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            path = None
    if path is None:
        path = f"{shared_folder(spark)}/market/{name}-{uuid.uuid4().hex}"
        write(path)
        _STORED[key] = path
    return path


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The derived table `name` of a folder, written at its first use and read from then on.

    Plans above it scan its columns only, and the source tables are not read again.
    """
    return spark.read.parquet(stored_folder(spark, sf_dir, name, lambda path: build().write.parquet(path)))


def stored_by(spark: SparkSession, sf_dir: str, name: str, key: str, order: str, parts: int, build: Callable[[], DataFrame]) -> DataFrame:
    """Like stored, in `parts` buckets by key, each a file sorted by key and order: groups and windows by key need no shuffle of it."""

    def write(path: str) -> None:
        build().repartition(parts, key).write.bucketBy(parts, key).sortBy(key, order).option("path", path).saveAsTable(_table(path))

    return spark.table(_table(stored_folder(spark, sf_dir, name, write)))


def _table(path: str) -> str:
    return "default." + path.rsplit("/", 1)[1].replace("-", "_")


def between(df: DataFrame, first: str | None = None, last: str | None = None, *, by: str = "date", before: str | None = None) -> DataFrame:
    """Rows of a stored table from `first` to `last`, both included, or up to but not including `before`; the scan prunes by them."""
    for bound, test in ((first, ">="), (last, "<="), (before, "<")):
        if bound is not None:
            df = df.filter(F.expr(f"{by} {test} DATE '{bound}'"))
    return df


def on(df: DataFrame, day: str, *, by: str = "date") -> DataFrame:
    return df.filter(F.expr(f"{by} = DATE '{day}'"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """stored with the rows of new in place of those with their keys; columns that one side lacks are null.

    Of rows of new that repeat a key the last by `order` counts (without one, that
    which is last by all columns); rows with an empty event id don't.
    """
    if "source_event_id" in keys:
        new = new.filter("source_event_id <> ''")
    rest = [F.col(c) for c in new.columns if c not in keys]
    by = F.struct(F.col(order), *rest) if order else F.struct(*rest) if rest else F.lit(1)
    if rest:
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("last_")).select(*keys, "last_.*")
    else:
        new = new.dropDuplicates(keys)
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def first_of(rows: DataFrame, keys: list[str], *order: str, last: bool = False) -> DataFrame:
    """One row for each key: the first by order, or the last; rows of a key are reduced in every task before they meet."""
    rest = [F.col(c) for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("picked_")).select(*keys, "picked_.*")


def replace_partitions(df: DataFrame, path: str, by: str = "date") -> None:
    """Write df over the partitions it has; the others of the folder stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_run(spark: SparkSession, path: str, run_name: str, first: str, last: str, metrics: DataFrame) -> str:
    """Append the metrics of a run, one JSON a row, under a new id, which is returned."""
    run_id = uuid.uuid4().hex
    row = metrics.select(F.lit(run_id).alias("run_id"), F.lit(run_name).alias("run_name"), F.lit(first).alias("from_date"), F.lit(last).alias("to_date"), F.to_json(F.struct("*")).alias("metrics_json"))
    row.write.mode("append").parquet(path)
    return run_id


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, quotes doubled; for results as small as a report."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def snapshots(regime: DataFrame, sectors: DataFrame, stocks: DataFrame) -> DataFrame:
    """(score_date, json): one document a date with the regime, sectors and stocks in rank order."""
    listed = lambda df, name: df.groupBy("score_date").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in df.columns if c not in ("rank", "score_date")]))).alias(name))  # noqa: E731  a date has a dozen sectors and 50 stocks
    both = regime.join(listed(sectors, "sectors"), "score_date", "left").join(listed(stocks, "stocks"), "score_date", "left")
    return both.select("score_date", F.to_json(F.struct(*[c for c in both.columns])).alias("json"))
