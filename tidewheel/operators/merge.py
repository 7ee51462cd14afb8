"""Writes by key and by range into stores that lie by month.

A store is a folder of parquet partitions, one for each month of its date column.
A write finds the months it touches, builds those anew beside the store and then
puts them in place of the old ones; all other months keep their files. What was
built stays until it is in place, so a write that was cut off is finished by
recover() and can be repeated without harm. One writer at a time.

Defined cases: of new rows that repeat a key the last one by `order` counts; rows
without a date lie in month 0; columns that one side lacks are null; structured
events without an id are skipped; a month left without rows is removed; writing
nothing changes nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.config import NEWS_SOURCE_PREFIX
from tidewheel.functions.expressions import r6
from tidewheel.operators import store
from tidewheel.operators.oracle import with_
from tidewheel.sources.adapter import market_events, prices_daily

MONTH = "month"


def month_of(by: str):
    return F.coalesce(F.year(by) * 100 + F.month(by), F.lit(0)).cast("int").alias(MONTH)


def laid_out(df: DataFrame, by: str) -> DataFrame:
    """df with its month, in ranges of it, so that a task writes few months and a large month is written by many tasks."""
    return df.withColumn(MONTH, month_of(by)).repartitionByRange(MONTH, by, *[c for c in ("symbol",) if c in df.columns]).sortWithinPartitions(MONTH, by)


def write(df: DataFrame, path: str, by: str = "date") -> None:
    """A new store."""
    laid_out(df, by).write.partitionBy(MONTH).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, *, by: str = "date", before: str | None = None) -> DataFrame:
    """Rows from `first` to `last`, both included, or up to but not including `before`; only the months between are read."""
    df = _held(spark, path)
    for bound, test in ((first, ">="), (last, "<="), (before, "<=")):
        if bound is not None:
            day = dt.date.fromisoformat(bound)
            df = df.filter(f"{MONTH} {test} {day.year * 100 + day.month}")
    return store.between(df, first, last, by=by, before=before).drop(MONTH)


def merge(spark: SparkSession, path: str, new: DataFrame, keys: list[str], *, by: str = "date", order: str | None = None) -> list[int]:
    """Put rows of new in place of those with their keys, or beside them; returns the months that were written."""
    if "source_event_id" in keys:
        new = new.filter("source_event_id <> ''")
    new = _kept(new)
    months = _months(new.select(month_of(by)))
    if not months:
        return []
    if not exists(spark, path):
        write(store.upsert(new.limit(0), new, keys, order), path, by)
        return months
    held = _held(spark, path)
    if by not in keys:  # a key may have moved from another month
        months = sorted({*months, *_months(held.select(*keys, MONTH).join(new.select(*keys).distinct(), keys, "left_semi").select(MONTH))})
    _put(spark, path, store.upsert(held.filter(F.col(MONTH).isin(months)).drop(MONTH), new, keys, order), months, by)
    return months


def replace_range(spark: SparkSession, path: str, new: DataFrame, first: str, last: str, *, where: str, by: str = "date") -> list[int]:
    """Put new in place of the rows from first to last for which `where` holds; returns the months that were written."""
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    between = range(a.year * 12 + a.month - 1, b.year * 12 + b.month)
    new = _kept(new)
    months = sorted({*(m // 12 * 100 + m % 12 + 1 for m in between), *_months(new.select(month_of(by)))})
    if not exists(spark, path):
        write(new, path, by)
        return months
    held = _held(spark, path).filter(F.col(MONTH).isin(months)).drop(MONTH)
    gone = F.coalesce(F.expr(f"{by} BETWEEN DATE '{first}' AND DATE '{last}' AND ({where})"), F.lit(False))
    _put(spark, path, held.filter(~gone).unionByName(new, allowMissingColumns=True), months, by)
    return months


def replace_news(spark: SparkSession, path: str, news: DataFrame, first: str, last: str, *, prefix: str = NEWS_SOURCE_PREFIX) -> list[int]:
    """News of the days from first to last whose source begins with the prefix are replaced; other events stay."""
    return replace_range(spark, path, news, first, last, where=f"event_type = 'news' AND startswith(source, '{prefix}:')")


def _held(spark: SparkSession, path: str) -> DataFrame:
    """The store as it is; months written before a column was added have null there."""
    return spark.read.option("mergeSchema", True).parquet(path)


def _kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder: it is read for its months and for its rows."""
    path = f"{store.shared_folder(df.sparkSession)}/market/batch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _months(months: DataFrame) -> list[int]:
    """The distinct months: as many as the calendar has, never as rows."""
    return sorted(r[0] for r in months.distinct().collect())


def _put(spark: SparkSession, path: str, rows: DataFrame, months: list[int], by: str) -> None:
    staged = f"{path}.staged/{uuid.uuid4().hex}"
    laid_out(rows, by).write.partitionBy(MONTH).parquet(f"{staged}/rows")
    spark.createDataFrame([(m,) for m in months], "touched int").coalesce(1).write.parquet(f"{staged}/months")
    _apply(spark, path, staged)


def _apply(spark: SparkSession, path: str, staged: str) -> None:
    built = {int(m) for m in _partitions(spark, f"{staged}/rows")}
    if built:
        store.replace_partitions(spark.read.parquet(f"{staged}/rows"), path, MONTH)
    for (month,) in spark.read.parquet(f"{staged}/months").collect():
        if month not in built:
            remove(spark, f"{path}/{MONTH}={month}")
    remove(spark, staged)


def _partitions(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [name.split("=")[1] for name in (s.getPath().getName() for s in fs.listStatus(p)) if name.startswith(f"{MONTH}=")]


def recover(spark: SparkSession, path: str) -> int:
    """Finish writes that were built but not put in place; what was not built to the end is dropped. Returns how many were finished."""
    if not exists(spark, f"{path}.staged"):
        return 0
    fs, p = _fs(spark, f"{path}.staged")
    done = 0
    for folder in sorted((s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(p)):
        if exists(spark, f"{folder[1]}/months/_SUCCESS"):
            _apply(spark, path, folder[1])
            done += 1
        else:
            remove(spark, folder[1])
    return done


# ---- queries: two batches each, then the store as it is read back -------------------

_FIRST, _SECOND = "1995-06-15", "1995-09-20"
_EVENT = ["concat('feed:', CAST(event_id % 3 AS {0})) AS source", "CAST(event_id AS {0}) AS source_event_id", "symbol", "date", "event_type", "headline"]


def _path(spark: SparkSession, name: str) -> str:
    return f"{store.shared_folder(spark)}/market/{name}-{uuid.uuid4().hex}"


def merged_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices up to a day, then a second batch that revises the last months, each row of it twice, and goes on."""
    prices = _kept(prices_daily(spark, sf_dir).select("symbol", "date", "close", "volume"))
    path = _path(spark, "merged-prices")
    merge(spark, path, prices.filter(f"date < DATE '{_SECOND}'"), store.KEYS["prices_daily"])
    twice = prices.filter(f"date >= DATE '{_FIRST}'").withColumn("take", F.explode(F.array(F.lit(2), F.lit(1))))
    merge(spark, path, twice.withColumn("volume", F.col("volume") + F.col("take")), store.KEYS["prices_daily"], order="take")
    return read(spark, path).selectExpr("symbol", "date", r6("close"), "volume", "coalesce(take, 0) AS take")


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, then a third of them with a later date: they leave their old month; those without an id are skipped."""
    events = _kept(market_events(spark, sf_dir).selectExpr(*(x.format("STRING") for x in _EVENT)))
    path = _path(spark, "merged-events")
    merge(spark, path, events, store.KEYS["events"])
    moved = events.filter("source = 'feed:0'").withColumns({"date": F.date_add("date", 45), "headline": F.concat("headline", F.lit(" (moved)")), "source_event_id": F.when(F.col("source_event_id").endswith("7"), "").otherwise(F.col("source_event_id"))})
    merge(spark, path, moved, store.KEYS["events"])
    return read(spark, path)


_NEWS_FROM, _NEWS_TO = "2001-10-12", "2001-10-25"


def replaced_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of days' news of one source family is replaced; earnings, filings and other sources stay."""
    events = _kept(market_events(spark, sf_dir).selectExpr(*(x.format("STRING") for x in _EVENT)).withColumn("source", F.when(F.col("source") == "feed:2", "other:2").otherwise(F.col("source"))))
    path = _path(spark, "replaced-news")
    write(events, path)
    news = events.filter(f"event_type = 'news' AND date BETWEEN DATE '{_NEWS_FROM}' AND DATE '{_NEWS_TO}' AND source = 'feed:1'").withColumn("headline", F.concat(F.lit("late "), F.col("headline")))
    replace_news(spark, path, news, _NEWS_FROM, _NEWS_TO, prefix="feed")
    return read(spark, path)


_EVENTS_SQL = f"SELECT {', '.join(x.format('VARCHAR') for x in _EVENT)} FROM x_events"
_OLD_NEWS = f"event_type = 'news' AND source LIKE 'feed:%' AND date BETWEEN DATE '{_NEWS_FROM}' AND DATE '{_NEWS_TO}'"
QUERIES = {"k01_merged_prices": merged_prices, "k05_merged_events": merged_events, "k04_replaced_news": replaced_news}
ORACLE = {
    "k01_merged_prices": with_(
        f"SELECT a.symbol, a.date, {r6('a.close', 'close')}, a.volume, 0 AS take FROM x_prices a ANTI JOIN (SELECT * FROM x_prices WHERE date >= DATE '{_FIRST}') b USING (symbol, date) WHERE a.date < DATE '{_SECOND}' UNION ALL SELECT symbol, date, {r6('close')}, volume + 2, 2 FROM x_prices WHERE date >= DATE '{_FIRST}'"
    ),
    "k05_merged_events": with_(
        f"SELECT source, source_event_id, symbol, CASE WHEN moves THEN date + 45 ELSE date END AS date, event_type, CASE WHEN moves THEN headline || ' (moved)' ELSE headline END AS headline FROM (SELECT *, source = 'feed:0' AND NOT ends_with(source_event_id, '7') AS moves FROM ({_EVENTS_SQL}))"
    ),
    "k04_replaced_news": with_(
        f"SELECT * REPLACE (CASE WHEN {_OLD_NEWS} THEN 'late ' || headline ELSE headline END AS headline) FROM (SELECT * REPLACE (CASE source WHEN 'feed:2' THEN 'other:2' ELSE source END AS source) FROM ({_EVENTS_SQL})) WHERE NOT ({_OLD_NEWS}) OR source = 'feed:1'"
    ),
}
