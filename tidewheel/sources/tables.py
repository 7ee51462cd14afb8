"""Screener pages: rows of HTML tables by a table function, joined laterally to their pages.

A page's rows are those of class `styled-row` in its first table of class
`screener_table`; cells count by position, a row with too few is left out. The
ticker is the text of the row's `tab-link`, or its second cell without one.
Markup may be broken: a cell ends where the next cell, row or the table ends, a
row where the next row begins, and the end of the text ends everything. Null and
tableless pages have no rows.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.expressions import r6
from tidewheel.operators import store
from tidewheel.operators.oracle import with_
from tidewheel.sources.adapter import read

#: Positions of the columns in either view of a screener page.
OVERVIEW = {"company": 2, "sector": 3, "industry": 4, "market_cap": 6, "pe": 7, "price": 8, "change": 9, "volume": 10}
FINANCIAL = {"dividend": 3, "roa": 4, "roe": 5, "debt_equity": 10, "net_margin": 13}
LEAST = {"overview": 11, "financial": 14}


class _Table(HTMLParser):
    """Rows of a page's screener table: (cells, ticker of the link)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[list[str], str]] = []
        self.depth = self.over = 0
        self.cells: list[str] | None = None
        self.cell: list[str] | None = None
        self.link: list[str] | None = None
        self.ticker = ""

    def handle_starttag(self, tag, attrs):
        names = (dict(attrs).get("class") or "").split()
        if tag == "table" and not self.over:
            if self.depth or "screener_table" in names:
                self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.end_row()
            if "styled-row" in names:
                self.cells = []
        elif self.depth == 1 and tag == "td":
            self.end_cell()
            if self.cells is not None:
                self.cell = []
        elif tag == "a" and self.cell is not None and "tab-link" in names and not self.ticker:
            self.link = []

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.end_row()
                self.over = 1
        elif self.depth == 1 and tag == "td":
            self.end_cell()
        elif self.depth == 1 and tag == "tr":
            self.end_row()
        elif tag == "a":
            self.end_link()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        if self.link is not None:
            self.link.append(data)

    def end_link(self):
        if self.link is not None:
            self.ticker, self.link = "".join(self.link).strip(), None

    def end_cell(self):
        self.end_link()
        if self.cell is not None and self.cells is not None:
            self.cells.append("".join(self.cell).strip())
        self.cell = None

    def end_row(self):
        self.end_cell()
        if self.cells is not None:
            self.rows.append((self.cells, self.ticker))
        self.cells, self.ticker = None, ""


def rows_of(html: str | None, least: int) -> list[tuple[list[str], str]]:
    """(cells, ticker) of the rows of a page with `least` cells or more."""
    parser = _Table()
    parser.feed(html or "")
    parser.close()
    parser.end_row()
    return [(cells, ticker or cells[1]) for cells, ticker in parser.rows if len(cells) >= least]


def _function(view: str, places: dict[str, int]) -> type:
    class Rows:
        def eval(self, html: str):
            for n, (cells, ticker) in enumerate(rows_of(html, LEAST[view])):
                yield n, ticker, *(cells[p] for p in places.values())

    return F.udtf(Rows, returnType="row int, ticker string, " + ", ".join(f"{c} string" for c in places))


def table_rows(pages: DataFrame, view: str, html: str = "html") -> DataFrame:
    """Columns of pages but html, then row, ticker and the view's columns as texts; view is `overview` or `financial`."""
    spark = pages.sparkSession
    spark.udtf.register(f"screener_{view}", _function(view, {"overview": OVERVIEW, "financial": FINANCIAL}[view]))
    rest = ", ".join(f"p.`{c}`" for c in pages.columns if c != html)
    return spark.sql(f"SELECT {rest}, t.* FROM {{pages}} AS p, LATERAL screener_{view}(p.`{html}`) AS t", pages=pages)


def number(text: str) -> Column:
    """A figure as shown, such as 12.5%, 1,204 or 3.1B; `-` and what is none are null."""
    bare = F.regexp_replace(F.trim(text), "[,%$]", "")
    scale = F.when(bare.endswith("K"), 1e3).when(bare.endswith("M"), 1e6).when(bare.endswith("B"), 1e9).when(bare.endswith("T"), 1e12).otherwise(1.0)
    return F.regexp_replace(bare, "[KMBT]$", "").try_cast("double") * scale


# ---- queries over pages made of the parts table ---------------------------------------

PER_PAGE = 20
_TICKER = "concat('P', lpad(CAST(p_partkey AS STRING), 8, '0'))"
_CELLS = {
    "overview": [f"concat('<a class=\"company-ticker\"><span>A</span></a> <a class=\"tab-link\"> ', {_TICKER}, ' </a>')", "concat(' ', p_name, '\\n')", "p_brand", "p_type", "'USA'", "concat(CAST(p_size AS STRING), '.5B')", "CASE WHEN p_partkey % 7 = 0 THEN '-' ELSE CAST(p_size AS STRING) END", "CAST(p_partkey % 100 AS STRING)", "concat(CAST(p_partkey % 9 AS STRING), '.25%')", "concat('1,', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'))"],
    "financial": [_TICKER, "'2B'", "concat(CAST(p_size AS STRING), '.5%')", "concat('-', CAST(p_partkey % 5 AS STRING), '.5%')", "concat(CAST(p_partkey % 50 AS STRING), '%')", "'x'", "'x'", "'x'", "'x'", "CASE WHEN p_partkey % 6 = 0 THEN '-' ELSE concat('0.', CAST(p_partkey % 10 AS STRING)) END", "'x'", "'x'", "concat(CAST(p_partkey % 40 AS STRING), '.1%')", "'May 1'"],
}


def made_pages(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """(page, html): the parts in pages of PER_PAGE rows; every third page leaves its cells unclosed, every fifth has rows that are too short."""
    part = read(spark, sf_dir, "part").withColumn("page", F.floor(F.col("p_partkey") / PER_PAGE))
    cells = F.array(F.col("p_partkey").cast("string"), *(F.expr(x) for x in _CELLS[view]))
    end = F.when(F.col("page") % 3 == 0, "").otherwise("</td>")
    row = F.concat(F.lit("<tr class='styled-row is-bordered'>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), c, end)), ""), F.when(F.col("page") % 3 == 0, "").otherwise("</tr>"))
    short = F.when((F.col("page") % 5 == 0) & (F.col("p_partkey") % 4 == 0), "<tr class='styled-row'><td>1</td><td>SHORT</td></tr>").otherwise("")
    listed = part.select("page", F.struct("p_partkey", F.concat(row, short).alias("html")).alias("r")).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["html"]), "\n").alias("rows"))  # PER_PAGE rows
    return listed.select("page", F.concat(F.lit("<html><table><tr class='styled-row'><td>no screener</td></tr></table><table class='screener_table'><tr><th>No.</th></tr>"), "rows", F.lit("</table><table class='screener_table'><tr class='styled-row'>later</tr></table>")).alias("html"))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table_rows(made_pages(spark, sf_dir, "overview"), "overview")
    return out.select("ticker", "company", "sector", "industry", number("market_cap").alias("market_cap"), F.coalesce(number("pe"), F.lit(-1.0)).alias("pe"), number("price").alias("price"), number("change").alias("change"), number("volume").alias("volume"))


def financial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the financial view of every page twice: of equal tickers the first page's row is kept."""
    pages = made_pages(spark, sf_dir, "financial")
    again = pages.select((F.col("page") + 1_000_000).alias("page"), F.replace("html", F.lit("%"), F.lit("9%")).alias("html"))
    out = store.first_of(table_rows(pages.union(again), "financial"), ["ticker"], "page", "row")
    none = lambda c: F.coalesce(number(c), F.lit(-99.0))
    return out.select("ticker", *(none(c).alias(c) for c in FINANCIAL)).selectExpr("ticker", *(r6(c) for c in FINANCIAL))


QUERIES = {"s09_screener_overview": overview, "s10_screener_financial": financial}
_KEY = "'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0')"
ORACLE = {
    "s09_screener_overview": with_(f"SELECT {_KEY} AS ticker, p_name AS company, p_brand AS sector, p_type AS industry, (p_size + 0.5::DOUBLE) * 1e9 AS market_cap, CASE WHEN p_partkey % 7 = 0 THEN -1.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS pe, CAST(p_partkey % 100 AS DOUBLE) AS price, p_partkey % 9 + 0.25::DOUBLE AS change, CAST(1000 + p_partkey % 1000 AS DOUBLE) AS volume FROM part"),
    "s10_screener_financial": with_(
        "SELECT ticker, " + ", ".join(r6(c) for c in FINANCIAL) + f" FROM (SELECT {_KEY} AS ticker, p_size + 0.5::DOUBLE AS dividend, -(p_partkey % 5 + 0.5::DOUBLE) AS roa, CAST(p_partkey % 50 AS DOUBLE) AS roe, CASE WHEN p_partkey % 6 = 0 THEN -99.0::DOUBLE ELSE (p_partkey % 10) / 10.0::DOUBLE END AS debt_equity, p_partkey % 40 + 0.1::DOUBLE AS net_margin FROM part)"
    ),
}
