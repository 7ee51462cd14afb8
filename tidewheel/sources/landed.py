"""Parsers of landed provider files: each takes a DataFrame of texts and returns typed rows.

Bars, macro observations and filings are JSON, the earnings calendar is CSV, lists of
index members are HTML. Malformed rows are skipped where a feed is known to have them
(earnings); a macro value that is no number is an error, "." is a gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BARS = "bars map<string, array<struct<t: string, o: double, h: double, l: double, c: double, v: double, vw: double>>>"
FORMS = ("8-K", "10-Q", "10-K")
FILING_DAYS = 14


def bars(texts: DataFrame, column: str = "json") -> DataFrame:
    """(symbol, ts, date, open, high, low, close, ac, volume, vwap); the date is the timestamp's own, adjusted closes are the closes."""
    each = texts.select(F.from_json(column, BARS).alias("j")).select(F.explode("j.bars").alias("symbol", "list")).select("symbol", F.explode("list").alias("b"))
    return each.select("symbol", F.to_timestamp("b.t").alias("ts"), F.to_date(F.substring("b.t", 1, 10)).alias("date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.c").alias("ac"), F.col("b.v").alias("volume"), F.col("b.vw").alias("vwap"))


def intraday(texts: DataFrame, date: str, column: str = "json") -> DataFrame:
    return bars(texts, column).filter(F.col("date") == F.to_date(F.lit(date)))


def news(texts: DataFrame, requested: DataFrame, column: str = "json") -> DataFrame:
    """(symbol, date, event_type, headline, url, source_event_id) for each requested symbol of each article."""
    schema = "news array<struct<id: long, headline: string, url: string, created_at: string, symbols: array<string>>>"
    each = texts.select(F.explode(F.from_json(column, schema)["news"]).alias("n")).select(F.explode("n.symbols").alias("symbol"), "n")
    return each.join(requested.select("symbol").distinct(), "symbol", "left_semi").select("symbol", F.to_date(F.substring("n.created_at", 1, 10)).alias("date"), F.lit("news").alias("event_type"), F.col("n.headline").alias("headline"), F.col("n.url").alias("url"), F.col("n.id").cast("string").alias("source_event_id"))


def observations(texts: DataFrame, column: str = "json") -> DataFrame:
    """(series, date, value) from columns series and json."""
    schema = "observations array<struct<date: string, value: string>>"
    each = texts.select("series", F.explode(F.from_json(column, schema)["observations"]).alias("o")).filter("o.value <> '.'")
    return each.select("series", F.to_date("o.date").alias("date"), F.col("o.value").cast("double").alias("value"))


def tickers(texts: DataFrame, column: str = "json") -> DataFrame:
    """(ticker, cik, title) of a JSON object of companies; tickers are in upper case, the last company of one counts."""
    schema = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
    each = texts.select(F.explode(F.from_json(column, schema)).alias("no", "c")).select("no", F.upper("c.ticker").alias("ticker"), F.col("c.cik_str").alias("cik"), F.col("c.title").alias("title"))
    return each.filter("ticker IS NOT NULL AND cik IS NOT NULL").groupBy("ticker").agg(F.max_by(F.struct("cik", "title"), F.struct(F.expr("try_cast(no AS bigint)"), "no")).alias("c")).select("ticker", "c.*")


def with_cik(symbols: DataFrame, companies: DataFrame) -> DataFrame:
    """symbols with cik and title of their ticker, else of the ticker with `-` for `.`; those without either are left out.

    Each symbol asks under both spellings at once, so companies are joined once.
    """
    upper = F.upper("symbol")
    asked = symbols.withColumn("asked", F.explode(F.array_distinct(F.array(upper, F.replace(upper, F.lit("."), F.lit("-"))))))
    met = asked.join(companies, asked["asked"] == companies["ticker"])
    rest = [c for c in symbols.columns if c != "symbol"]
    own = F.struct((F.col("asked") != upper).alias("second"))
    return met.groupBy("symbol").agg(F.min_by(F.struct(*rest, "cik", "title"), own).alias("c")).select("symbol", "c.*")


def earnings(lines: DataFrame, requested: DataFrame, column: str = "value") -> DataFrame:
    """(symbol, date, event_type, estimate, source_event_id) from lines symbol,name,reportDate,fiscalDateEnding,estimate,currency."""
    cells = lines.select(F.from_csv(F.col(column), "symbol string, name string, report string, fiscal string, estimate string, currency string", {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("c")).select("c.*")
    typed = cells.select(F.upper(F.trim("symbol")).alias("symbol"), F.expr("try_to_date(report, 'yyyy-MM-dd')").alias("date"), F.expr("try_cast(estimate AS double)").alias("estimate")).filter("date IS NOT NULL")
    return typed.join(requested.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "date", F.lit("earnings").alias("event_type"), "estimate", F.concat_ws(":", F.lit("earnings_calendar"), "symbol", F.col("date").cast("string")).alias("source_event_id"))


def filings(texts: DataFrame, end: str, days: int = FILING_DAYS, column: str = "json") -> DataFrame:
    """(symbol, date, event_type, headline, source_event_id, url) from columns symbol, cik and json with parallel arrays."""
    schema = "filings struct<recent: struct<form: array<string>, filingDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>>"
    r = F.from_json(column, schema)["filings"]["recent"]
    each = texts.select("symbol", F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.explode(F.arrays_zip(r["form"].alias("form"), r["filingDate"].alias("filed"), r["accessionNumber"].alias("accession"), r["primaryDocument"].alias("document"))).alias("f"))
    rows = each.select("symbol", "cik", "f.*").withColumn("date", F.expr("try_to_date(filed, 'yyyy-MM-dd')"))
    last = F.to_date(F.lit(end))
    kept = rows.filter(F.col("form").isin(*FORMS) & F.col("date").between(F.date_sub(last, days), last))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("long").cast("string"), F.lit("/"), F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"), F.col("document"))
    return kept.select("symbol", "date", F.lit("filing").alias("event_type"), F.concat("form", F.lit(" filed by "), "symbol").alias("headline"), F.concat_ws(":", F.lit("submissions"), "cik", "accession").alias("source_event_id"), url.alias("url"))


class _Rows(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if self.rows:
                self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_rows(pages: DataFrame, key: str, html: str = "html", least: int = 1) -> DataFrame:
    """(key, row, cells) of every table row with `least` cells or more; white space inside cells is one blank."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame[html], strict=True):
                parser = _Rows()
                parser.feed(text or "")
                out += [(k, n, r) for n, r in enumerate(parser.rows) if len(r) >= least]
            yield pd.DataFrame(out, columns=[key, "row", "cells"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, row int, cells array<string>")


def members(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(symbol, name, sector, industry) of an index's member table."""
    c = F.col("cells")
    sector = F.when(c[2] == "Information Technology", "Technology").otherwise(c[2])
    return html_rows(pages, key, html, 4).filter(c[0] != "Symbol").select(c[0].alias("symbol"), c[1].alias("name"), sector.alias("sector"), c[3].alias("industry")).dropDuplicates(["symbol"])


def page_count(html: str, per_page: int = 20):
    """Column: pages of a screener, from the largest offset its footer links to."""
    offsets = F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"[?&;]r=(\d{1,9})"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.floor((F.array_max(offsets) + per_page - 1) / per_page).cast("int"), F.lit(1))
