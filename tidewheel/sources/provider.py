"""What the daily run asks its providers for, and a provider of landed files.

The protocols are the surface: each method returns a DataFrame of the columns
that the store keeps. LandedProvider answers from a folder of files as the feeds
send them. Bars, macro observations, earnings and filings come through the data
source `landed` (a partition for each file, Arrow batches, rows before a date
bound are not built); news, the ticker map and members are parsed by Spark.

gather() asks for everything a run needs and says what to do about failures: no
prices or macro observations end the run, the universe falls back to the active
symbols stored last, event sources to nothing; each fallback is a warning row.
"""

from __future__ import annotations

import csv
import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewheel.functions.expressions import r6
from tidewheel.operators import store
from tidewheel.operators.oracle import with_
from tidewheel.sources import landed
from tidewheel.sources.adapter import macro_series, market_events, prices_daily, symbols


class DailyBars(Protocol):
    def universe(self) -> DataFrame: ...
    def daily_prices(self, symbols: DataFrame, end: str) -> DataFrame: ...


class IntradayBars(Protocol):
    def intraday_prices(self, symbols: DataFrame, date: str, timeframe: str) -> DataFrame: ...


class News(Protocol):
    def recent_news(self, symbols: DataFrame, end: str) -> DataFrame: ...


class Earnings(Protocol):
    def upcoming_earnings(self, symbols: DataFrame) -> DataFrame: ...


class Filings(Protocol):
    def recent_filings(self, symbols: DataFrame, end: str) -> DataFrame: ...


class Macro(Protocol):
    def macro_observations(self, end: str) -> DataFrame: ...


# ---- the data source -----------------------------------------------------------------

SCHEMAS = {
    "bars": "symbol string, ts timestamp, date date, open double, high double, low double, close double, ac double, volume double, vwap double",
    "macro": "series string, date date, value double",
    "earnings": "symbol string, date date, estimate double",
    "filings": "cik bigint, date date, form string, accession string, document string",
}


def _day(text: str | None) -> dt.date | None:
    try:
        return dt.date.fromisoformat(text)
    except (TypeError, ValueError):
        return None


def _bars(line: str, _: str) -> Iterator[tuple]:
    for symbol, rows in (json.loads(line).get("bars") or {}).items():
        for b in rows or ():
            ts = dt.datetime.fromisoformat(b["t"].replace("Z", "+00:00"))
            yield symbol, ts, _day(b["t"][:10]), b["o"], b["h"], b["l"], b["c"], b["c"], b["v"], b.get("vw")


def _macro(line: str, name: str) -> Iterator[tuple]:
    for o in json.loads(line)["observations"]:
        if o["value"] != ".":
            yield name, dt.date.fromisoformat(o["date"]), float(o["value"])


def _earnings(line: str, _: str) -> Iterator[tuple]:
    cells = [c.strip() for c in next(csv.reader([line]), [])]
    day = _day(cells[2]) if len(cells) > 4 else None
    if day:
        try:
            estimate = float(cells[4])
        except ValueError:
            estimate = None
        yield cells[0].upper(), day, estimate


def _filings(line: str, _: str) -> Iterator[tuple]:
    found = json.loads(line)
    recent = found["filings"]["recent"]
    for form, filed, accession, document in zip(recent["form"], recent["filingDate"], recent["accessionNumber"], recent["primaryDocument"], strict=False):
        yield int(found["cik"]), _day(filed), form, accession, document


#: kind: (parser of a line and its file's name, place of the date)
PARSERS = {"bars": (_bars, 2), "macro": (_macro, 1), "earnings": (_earnings, 1), "filings": (_filings, 1)}
BATCH = 8192


@dataclass
class File(InputPartition):
    path: str
    name: str


class LandedReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.schema = schema
        self.kind, self.path, self.first, self.last = options["kind"], options["path"], options.get("first"), options.get("last")

    def _fs(self):
        from pyarrow import fs

        if self.path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.path[len("file:") :].lstrip("/")
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[File]:
        """The files below the path; `name=value` folders name them, else their own names do."""
        from pyarrow import fs

        where, path = self._fs()
        out = []
        for f in where.get_file_info(fs.FileSelector(path, recursive=True)):
            parts = f.path.removeprefix(path).strip("/").split("/")
            if f.type == fs.FileType.File and f.size and not any(p[0] in "_." for p in parts):
                named = [p.split("=", 1)[1] for p in parts[:-1] if "=" in p]
                out.append(File(f.path, named[-1] if named else parts[-1].split(".")[0]))
        return out

    def read(self, partition: File) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        parse, place = PARSERS[self.kind]
        first, last = _day(self.first) or dt.date.min, _day(self.last) or dt.date.max
        kind = to_arrow_schema(self.schema)
        held: list[tuple] = []
        where, _ = self._fs()
        with where.open_input_stream(partition.path) as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    held += [r for r in parse(line.decode(), partition.name) if r[place] and first <= r[place] <= last] if line.strip() else []
                    if len(held) >= BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in held], kind)
                        held = []
            if rest.strip():
                held += [r for r in parse(rest.decode(), partition.name) if r[place] and first <= r[place] <= last]
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in held], kind)


class LandedSource(DataSource):
    """spark.read.format("landed").option("kind", ...).load(path): rows of landed files, from `first` to `last` if these options are set."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> LandedReader:
        return LandedReader(dict(self.options), schema)


# ---- a provider of landed files --------------------------------------------------------


class LandedProvider:
    """Everything from one folder: universe/, bars/, intraday/<timeframe>/, news/, earnings/, companies/, filings/, macro/."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.dataSource.register(LandedSource)

    def rows(self, kind: str, folder: str | None = None, **bounds: str) -> DataFrame:
        return self.spark.read.format("landed").options(kind=kind, **bounds).load(f"{self.root}/{folder or kind}")

    def texts(self, folder: str) -> DataFrame:
        return self.spark.read.text(f"{self.root}/{folder}").withColumnRenamed("value", "json")

    def universe(self) -> DataFrame:
        pages = self.spark.read.text(f"{self.root}/universe", wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("html"))
        return landed.members(pages, "file")

    def daily_prices(self, symbols: DataFrame, end: str) -> DataFrame:
        return self.rows("bars", last=end).join(symbols.select("symbol").distinct(), "symbol", "left_semi").drop("ts")

    def intraday_prices(self, symbols: DataFrame, date: str, timeframe: str) -> DataFrame:
        bars = self.rows("bars", f"intraday/{timeframe}", first=date, last=date).join(symbols.select("symbol").distinct(), "symbol", "left_semi")
        return bars.drop("ac").withColumn("timeframe", F.lit(timeframe))

    def recent_news(self, symbols: DataFrame, end: str, days: int = 7) -> DataFrame:
        last = F.to_date(F.lit(end))
        return landed.news(self.texts("news"), symbols).filter(F.col("date").between(F.date_sub(last, days), last))

    def upcoming_earnings(self, symbols: DataFrame) -> DataFrame:
        rows = self.rows("earnings").join(symbols.select("symbol").distinct(), "symbol", "left_semi")
        return rows.select("symbol", "date", F.lit("earnings").alias("event_type"), "estimate", F.concat_ws(":", F.lit("earnings_calendar"), "symbol", F.col("date").cast("string")).alias("source_event_id"))

    def companies(self) -> DataFrame:
        return landed.tickers(self.texts("companies"))

    def recent_filings(self, symbols: DataFrame, end: str, days: int = landed.FILING_DAYS) -> DataFrame:
        last = dt.date.fromisoformat(end)
        asked = landed.with_cik(symbols.select("symbol").distinct(), self.companies()).select("symbol", "cik")
        rows = self.rows("filings", first=str(last - dt.timedelta(days)), last=end).filter(F.col("form").isin(*landed.FORMS)).join(asked, "cik")
        cik = F.lpad(F.col("cik").cast("string"), 10, "0")
        return rows.select("symbol", "date", F.lit("filing").alias("event_type"), F.concat("form", F.lit(" filed by "), "symbol").alias("headline"), F.concat_ws(":", F.lit("submissions"), cik, "accession").alias("source_event_id"))

    def macro_observations(self, end: str) -> DataFrame:
        return self.rows("macro", last=end)


# ---- what to do when a source fails ------------------------------------------------------


class NoData(RuntimeError):
    """A run can't go on without this source."""


@dataclass
class Gathered:
    symbols: DataFrame
    prices: DataFrame
    macro: DataFrame
    news: DataFrame
    earnings: DataFrame
    filings: DataFrame
    warned: list[tuple[str, str]] = field(default_factory=list)

    def warnings(self) -> DataFrame:
        """(source, warning), one row for each source that another one stood in for."""
        return self.symbols.sparkSession.createDataFrame(self.warned, "source string, warning string")


EVENTS = "symbol string, date date, event_type string, source_event_id string"


def landed_now(df: DataFrame, name: str) -> DataFrame:
    """df read to its end and kept in the shared folder: a source that fails does so here and not in a later plan."""
    path = f"{store.shared_folder(df.sparkSession)}/market/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def gather(spark: SparkSession, provider, end: str, last_universe: DataFrame | None = None) -> Gathered:
    """Everything that a run up to `end` needs. last_universe has the symbols stored last, with is_active."""
    warned: list[tuple[str, str]] = []

    def events(name: str, ask: Callable[[], DataFrame]) -> DataFrame:
        try:
            return landed_now(ask(), name)
        except Exception as e:  # whatever a feed does, the run goes on without it
            warned.append((name, f"{name} event source failed; continuing without {name} context ({_first_line(e)})"))
            return spark.createDataFrame([], EVENTS)

    def needed(name: str, ask: Callable[[], DataFrame]) -> DataFrame:
        rows = landed_now(ask(), name)
        if rows.isEmpty():
            raise NoData(f"no {name} came up to {end}")
        return rows

    try:
        universe = landed_now(provider.universe(), "universe")
    except Exception as e:
        universe = last_universe.filter("is_active").drop("is_active") if last_universe is not None else None
        if universe is None or universe.isEmpty():
            raise NoData("the universe failed and none is stored") from e
        warned.append(("universe", f"universe refresh failed; using {universe.count()} active symbols stored last ({_first_line(e)})"))
    return Gathered(
        universe,
        needed("prices", lambda: provider.daily_prices(universe, end)),
        needed("macro observations", lambda: provider.macro_observations(end)),
        events("news", lambda: provider.recent_news(universe, end)),
        events("earnings", lambda: provider.upcoming_earnings(universe)),
        events("filings", lambda: provider.recent_filings(universe, end)),
        warned,
    )


def _first_line(e: Exception) -> str:
    return str(e).strip().split("\n")[0][:300]


# ---- queries: the given tables as feeds would land them, then through the provider ----------

_END = "1996-12-31"
_EVENT_END = "2001-10-25"
_CIK = "try_cast(substring(symbol, 2, 6) AS BIGINT) + 7"
_SPELLED = "CASE WHEN pmod(try_cast(substring(symbol, 2, 6) AS BIGINT), 3) = 0 THEN concat(substring(symbol, 1, 3), '.', substring(symbol, 4, 4)) ELSE symbol END"


FEEDS = ("bars", "macro", "news", "earnings", "companies", "filings", "universe")


def land(spark: SparkSession, sf_dir: str, *feeds: str) -> str:
    """The folder of a made landing zone with these feeds, or all, written once a session."""
    feeds = feeds or FEEDS
    return store.stored_folder(spark, sf_dir, "-".join(("landing", *feeds)), lambda path: [_LAND[f](spark, sf_dir, f"{path}/{f}") for f in feeds])


def _land_bars(spark: SparkSession, sf_dir: str, path: str) -> None:
    by_symbol = lambda rows: F.to_json(F.struct(F.map_from_entries(F.array(F.struct("symbol", rows))).alias("bars")))
    t = F.concat(F.col("date").cast("string"), F.lit("T05:00:00Z"))
    prices = prices_daily(spark, sf_dir).select("symbol", F.struct(t.alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("close").alias("vw")).alias("b"))
    prices.groupBy("symbol").agg(F.array_sort(F.collect_list("b")).alias("rows")).select(by_symbol(F.col("rows"))).write.text(path)  # a symbol's days are bounded by the calendar


def _land_macro(spark: SparkSession, sf_dir: str, path: str) -> None:
    observed = macro_series(spark, sf_dir).select("series", F.struct(F.col("date").cast("string").alias("date"), F.when(F.dayofmonth("date") == 13, ".").otherwise(F.col("value").cast("string")).alias("value")).alias("o"))
    observed.groupBy("series").agg(F.array_sort(F.collect_list("o")).alias("observations")).select("series", F.to_json(F.struct("observations"))).write.partitionBy("series").text(path)


def _land_news(spark: SparkSession, sf_dir: str, path: str) -> None:
    article = F.struct(F.col("event_id").alias("id"), "headline", F.concat(F.lit("http://news.example/"), "event_id").alias("url"), F.concat(F.col("date").cast("string"), F.lit("T12:00:00Z")).alias("created_at"), F.array("symbol", F.lit("ELSE")).alias("symbols"))
    market_events(spark, sf_dir).filter("event_type = 'news'").select(F.to_json(F.struct(F.array(article).alias("news")))).write.text(path)


def _land_earnings(spark: SparkSession, sf_dir: str, path: str) -> None:
    line = F.concat_ws(",", F.lower("symbol"), F.lit("a name"), F.when(F.col("event_id") % 10 == 0, "soon").otherwise(F.col("date").cast("string")), F.lit("2001-12-31"), (F.col("event_id") % 5).cast("string"), F.lit("USD"))
    market_events(spark, sf_dir).filter("event_type = 'earnings'").select(line).write.text(path)


def _land_companies(spark: SparkSession, sf_dir: str, path: str) -> None:
    company = F.struct(F.expr(_CIK).alias("cik_str"), F.lower(F.replace(F.expr(_SPELLED), F.lit("."), F.lit("-"))).alias("ticker"), F.col("name").alias("title"))
    _stocks(spark, sf_dir).select(F.to_json(F.map_from_entries(F.array(F.struct(F.coalesce(F.expr(_CIK), F.lit(0)).cast("string"), company))))).write.text(path)


def _land_filings(spark: SparkSession, sf_dir: str, path: str) -> None:
    filed = market_events(spark, sf_dir).filter("event_type = 'filing'").select(F.expr(_CIK).alias("cik"), F.struct(F.split("headline", " ")[0].alias("form"), F.col("date").cast("string").alias("filed"), F.col("event_id").cast("string").alias("accession")).alias("f"))
    recent = F.struct(F.col("fs.form").alias("form"), F.col("fs.filed").alias("filingDate"), F.col("fs.accession").alias("accessionNumber"), F.transform("fs", lambda x: F.lit("doc.htm")).alias("primaryDocument"))
    filed.groupBy("cik").agg(F.array_sort(F.collect_list("f")).alias("fs")).select(F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings")))).write.text(path)  # one company's filings of a month


def _land_universe(spark: SparkSession, sf_dir: str, path: str) -> None:
    row = F.concat(F.lit("<tr><td> "), "symbol", F.lit("</td><td>"), "name", F.lit("</td><td>"), "sector", F.lit("</td><td>"), "industry", F.lit("</td></tr>"))
    _stocks(spark, sf_dir).select(F.concat(F.lit("<table>"), row, F.lit("</table>"))).write.text(path)


_LAND = {"bars": _land_bars, "macro": _land_macro, "news": _land_news, "earnings": _land_earnings, "companies": _land_companies, "filings": _land_filings, "universe": _land_universe}


def _stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).filter("asset_type = 'stock'")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stocks under the names that their feeds are asked for; every third has a dot."""
    return _stocks(spark, sf_dir).select(F.expr(_SPELLED).alias("symbol"))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).filter("asset_type = 'stock' AND symbol NOT LIKE '%9'").select("symbol")


_provider = lambda spark, d, *feeds: LandedProvider(spark, land(spark, d, *feeds))
QUERIES = {
    "s16_provider_prices": lambda spark, d: _provider(spark, d, "bars").daily_prices(_plain(spark, d), _END).selectExpr("symbol", "date", *(r6(c) for c in ("open", "high", "low", "close", "ac")), "volume"),
    "s16_provider_macro": lambda spark, d: _provider(spark, d, "macro").macro_observations(_END).selectExpr("series", "date", r6("value")),
    "s03_provider_news": lambda spark, d: _provider(spark, d, "news").recent_news(_plain(spark, d), _EVENT_END).select("symbol", "date", "event_type", "headline", "url", "source_event_id"),
    "s05_provider_earnings": lambda spark, d: _provider(spark, d, "earnings").upcoming_earnings(_plain(spark, d)),
    "s06_provider_filings": lambda spark, d: _provider(spark, d, "companies", "filings").recent_filings(_asked(spark, d), _EVENT_END),
    "s07_ticker_map": lambda spark, d: landed.with_cik(_asked(spark, d), _provider(spark, d, "companies").companies()),
    "s08_universe": lambda spark, d: _provider(spark, d, "universe").universe(),
}
_KEEP = "symbol IN (SELECT symbol FROM x_symbols WHERE asset_type = 'stock' AND symbol NOT LIKE '%9')"
_CIK_SQL = "CAST(substr(symbol, 2, 6) AS BIGINT) + 7"
_SPELLED_SQL = "CASE WHEN CAST(substr(symbol, 2, 6) AS BIGINT) % 3 = 0 THEN substr(symbol, 1, 3) || '.' || substr(symbol, 4, 4) ELSE symbol END"
ORACLE = {
    "s16_provider_prices": with_(f"SELECT symbol, date, {', '.join(r6(c) for c in ('open', 'high', 'low', 'close', 'ac'))}, volume FROM x_prices WHERE {_KEEP} AND date <= DATE '{_END}'"),
    "s16_provider_macro": with_(f"SELECT series, date, {r6('value')} FROM x_macro WHERE day(date) <> 13 AND date <= DATE '{_END}'"),
    "s03_provider_news": with_(f"SELECT symbol, date, event_type, headline, 'http://news.example/' || event_id AS url, CAST(event_id AS VARCHAR) AS source_event_id FROM x_events WHERE event_type = 'news' AND {_KEEP} AND date BETWEEN DATE '{_EVENT_END}' - 7 AND DATE '{_EVENT_END}'"),
    "s05_provider_earnings": with_(f"SELECT symbol, date, event_type, CAST(event_id % 5 AS DOUBLE) AS estimate, 'earnings_calendar:' || symbol || ':' || CAST(date AS VARCHAR) AS source_event_id FROM x_events WHERE event_type = 'earnings' AND event_id % 10 <> 0 AND {_KEEP}"),
    "s06_provider_filings": with_(
        f"SELECT {_SPELLED_SQL} AS symbol, date, event_type, split_part(headline, ' ', 1) || ' filed by ' || {_SPELLED_SQL} AS headline, 'submissions:' || lpad(CAST({_CIK_SQL} AS VARCHAR), 10, '0') || ':' || event_id AS source_event_id FROM x_events WHERE event_type = 'filing' AND date BETWEEN DATE '{_EVENT_END}' - {landed.FILING_DAYS} AND DATE '{_EVENT_END}'"
    ),
    "s07_ticker_map": with_(f"SELECT {_SPELLED_SQL} AS symbol, {_CIK_SQL} AS cik, name AS title FROM x_symbols WHERE asset_type = 'stock'"),
    "s08_universe": with_("SELECT symbol, name, sector, industry FROM x_symbols WHERE asset_type = 'stock'"),
}
