"""What one run leaves to the next: catalyst statuses, label components, event sectors, counters and snapshot files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel.functions.expressions import r6
from tidewheel.operators import merge, store
from tidewheel.operators.oracle import CTES, cte, with_
from tidewheel.plans.backtest import ACTION_GROUPS, Tested
from tidewheel.plans.labels import CONDITIONS, Labelled, catalysts

# ---- catalyst statuses -------------------------------------------------------------


def keep_catalysts(status: DataFrame, held: DataFrame, report_date: DataFrame) -> DataFrame:
    """status (score_date, symbol, catalyst) with the held catalyst where one that is not pending is held and the day lies before report_date.

    report_date has one row. A status of the report's own day is always the new one.
    """
    day = report_date.toDF("report_date")
    kept = held.filter(F.col("catalyst") != C.PENDING).crossJoin(F.broadcast(day)).filter("score_date < report_date").select("score_date", "symbol", F.col("catalyst").alias("kept"))
    return status.join(kept, ["score_date", "symbol"], "left").select("score_date", "symbol", F.coalesce("kept", "catalyst").alias("catalyst"))


def run_catalysts(spark: SparkSession, path: str, status: DataFrame) -> None:
    """One run: statuses of the store overlay the new ones and the result is merged into it."""
    if merge.exists(spark, path):
        held = merge.read(spark, path, by="score_date")
        status = keep_catalysts(status, held, status.agg(F.max("score_date")))
    merge.merge(spark, path, status, ["score_date", "symbol"], by="score_date")


_LAST = "2001-10-28"


def kept_catalysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after two runs: the first knows two of three events, the second others, and days that are new to it."""
    m = Labelled(spark, sf_dir)
    path = f"{store.shared_folder(spark)}/market/statuses-{uuid.uuid4().hex}"
    stocks = m.stock_scores()
    run_catalysts(spark, path, catalysts(stocks.filter(f"score_date <= DATE '{_LAST}'"), m.events.filter("event_id % 3 < 2")))
    run_catalysts(spark, path, catalysts(stocks, m.events.filter("event_id % 3 > 0")))
    return merge.read(spark, path, by="score_date")


_RUN = CTES["x_catalysts"]
cte("x_run1_stocks", f"SELECT * FROM x_stocks WHERE score_date <= DATE '{_LAST}'")
cte("x_run1_events", "SELECT * FROM x_events WHERE event_id % 3 < 2")
cte("x_run2_events", "SELECT * FROM x_events WHERE event_id % 3 > 0")
cte("x_run1", _RUN.replace("x_stocks", "x_run1_stocks").replace("x_events", "x_run1_events"))
cte("x_run2", _RUN.replace("x_events", "x_run2_events"))
_KEPT_SQL = f"SELECT n.score_date, n.symbol, CASE WHEN n.score_date < (SELECT max(score_date) FROM x_run2) AND o.catalyst <> '{C.PENDING}' THEN o.catalyst ELSE n.catalyst END AS catalyst FROM x_run2 n LEFT JOIN x_run1 o ON o.score_date = n.score_date AND o.symbol = n.symbol"

# ---- label components --------------------------------------------------------------

#: Names of the stored components. name in JSON: column
MEASURES = {"distance_from_20d_ma_pct": "dist20", "distance_from_50d_ma_pct": "dist50", "atr_14d_pct": "atr_pct", "atr_extension_from_20d_ma": "atr_ext20", "atr_extension_from_50d_ma": "atr_ext50", "distance_from_20d_high_pct": "dist20high", "distance_from_60d_high_pct": "dist60high", "range_10d_pct": "range10", "gap_pct": "gap0", "true_range_pct": "tr_pct"}
REQUIRED = ("distance_from_20d_ma_pct", "distance_from_50d_ma_pct", "atr_extension_from_20d_ma", "distance_from_20d_high_pct", "range_10d_pct")
NONE = C.PRIMARY_ORDER[-1]


def components(actions: DataFrame) -> DataFrame:
    """actions with components_json: the measures that are there, all labels and the primary one."""
    return actions.withColumn("components_json", F.to_json(F.struct(*(F.col(c).alias(k) for k, c in MEASURES.items()), F.split("labels", r"\|").alias("actionability_labels"), F.col("primary").alias("primary_actionability"))))


def read_components(rows: DataFrame, column: str = "components_json") -> DataFrame:
    """rows with the measures, complete, labels (joined by |) and primary out of their components.

    Each field is read by itself, so that one of another type does not take the
    rest with it. A missing or broken measure is 0, and any of REQUIRED that is
    missing makes the row incomplete. No labels, or none that is a text, are
    `unclassified_leader`; a missing primary is the first label in primary order.
    """
    raw = F.from_json(column, "map<string, string>")
    figure = lambda k: raw[k].try_cast("double")
    out = rows.select("*", *(F.coalesce(figure(k), F.lit(0.0)).alias(c) for k, c in MEASURES.items()))
    whole = F.lit(True)
    for k in REQUIRED:
        whole = whole & figure(k).isNotNull()
    # a JSON text that is an array of texts; others in it are passed over
    listed = F.filter(F.from_json(raw["actionability_labels"], "array<string>"), lambda x: x.isNotNull() & (x != ""))
    labels = F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(F.array(F.lit(NONE)))
    first = F.coalesce(*(F.when(F.array_contains("l_", k), k) for k in C.PRIMARY_ORDER), F.lit(NONE))
    return out.withColumn("complete", F.coalesce(whole, F.lit(False))).withColumn("l_", labels).withColumn("primary", F.coalesce(raw["primary_actionability"], first)).withColumn("labels", F.array_join("l_", "|")).drop("l_")


_BROKEN = "CAST(substring(symbol, 2, 6) AS INT) % 6"


def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and measures written as JSON and read back; five of six symbols' texts are damaged, each in another way."""
    rows = components(Labelled(spark, sf_dir).actions()).select("score_date", "symbol", "components_json")
    hurt = F.expr(f"CASE {_BROKEN} WHEN 1 THEN regexp_replace(components_json, '\"actionability_labels\":.*\\\\],', '') WHEN 2 THEN regexp_replace(components_json, '\"actionability_labels\":.*\\\\]', '\"actionability_labels\":[]') WHEN 3 THEN substring(components_json, 1, 20) WHEN 4 THEN regexp_replace(components_json, ',\"primary_actionability\":.*', '}}') WHEN 5 THEN regexp_replace(components_json, '\"range_10d_pct\":[^,]*', '\"range_10d_pct\":\"wide\"') ELSE components_json END")
    path = f"{store.shared_folder(spark)}/market/components-{uuid.uuid4().hex}"
    rows.withColumn("components_json", F.regexp_replace(hurt, r"\}\}$", "}")).write.parquet(path)
    return read_components(spark.read.parquet(path)).selectExpr("score_date", "symbol", "labels", "primary AS primary_label", "complete AS whole", r6("dist20"), r6("range10"))


_FIRST = "CASE " + " ".join(f"WHEN list_contains(string_split(labels, '|'), '{k}') THEN '{k}'" for k in C.PRIMARY_ORDER) + " END"
_WHOLE = " AND ".join(f"{MEASURES[k]} IS NOT NULL" for k in REQUIRED)
_K = "CAST(substr(symbol, 2, 6) AS INT) % 6"
_STORED_SQL = f"SELECT score_date, symbol, CASE WHEN k IN (1, 2, 3) THEN '{NONE}' ELSE labels END AS labels, CASE WHEN k = 3 THEN '{NONE}' WHEN k = 4 THEN {_FIRST} ELSE primary_ END AS primary_label, k NOT IN (3, 5) AND {_WHOLE} AS whole, {r6('CASE WHEN k = 3 THEN 0 ELSE coalesce(dist20, 0) END', 'dist20')}, {r6('CASE WHEN k IN (3, 5) THEN 0 ELSE coalesce(range10, 0) END', 'range10')} FROM (SELECT *, {_K} AS k FROM x_action)"

# ---- events and sectors ------------------------------------------------------------


def with_sectors(events: DataFrame, stocks: DataFrame) -> DataFrame:
    """events with the sector that their symbol's first row in stocks has, by day and rank; others have none."""
    first = store.first_of(stocks.select("symbol", "sector", "score_date", "rank"), ["symbol"], "score_date", "rank").select("symbol", "sector")
    return events.join(first, "symbol", "left")


def event_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Labelled(spark, sf_dir)
    return with_sectors(m.events, m.stock_scores().filter("rank <= 5")).select("event_id", "symbol", F.coalesce("sector", F.lit("")).alias("sector"))


def union_first(parts: list[DataFrame], keys: list[str], *order: str) -> DataFrame:
    """Rows of all parts, one for each key: that of the earliest part, there the first by order."""
    rows = None
    for n, part in enumerate(parts):
        one = part.withColumn("part_", F.lit(n))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return store.first_of(rows, keys, "part_", *order).drop("part_")


def merged_watchlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's first place on the watchlists of three quarters, the later quarters first."""
    watch = Labelled(spark, sf_dir).stock_scores().filter(f"rank <= {C.WATCHLIST}").select("symbol", "score_date", "rank", "sector")
    return union_first([watch.filter(f"quarter(score_date) = {q}") for q in (4, 2, 1)], ["symbol"], "score_date", "rank")


# ---- counters ----------------------------------------------------------------------

_USEFUL = " OR ".join(list(CONDITIONS)[1:])
_COUNTS = {
    "watchlist_rows": "count_if(first_horizon)",
    "extended_rows": "count_if(first_horizon AND extended_leader)",
    "useful_review_rows": f"count_if(first_horizon AND ({_USEFUL}))",
    "unclassified_rows": f"count_if(first_horizon AND labels = '{NONE}')",
    "event_rows": f"count_if(first_horizon AND catalyst <> '{C.PENDING}')",
    "pending_rows": f"count_if(first_horizon AND catalyst = '{C.PENDING}')",
    "forward_observations": "count_if(ret IS NOT NULL)",
    "skipped_missing": "count_if(ret IS NULL)",
}


def counted_summary(m: Tested, watch: DataFrame, funds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary by group and horizon, one row of counters): the counters are gathered while the summary's rows pass by.

    watch is the labelled watchlist. A row counts once a horizon; it is skipped if
    its sector has no fund or stock, fund or benchmark lack a return.
    """
    horizons = ", ".join(f"named_struct('horizon', {h}, 'own_ret', CASE WHEN bar_date = score_date THEN fwd{h} END)" for h in C.HORIZONS)
    own = m.fwd.withColumnRenamed("date", "score_date")
    fund = own.join(F.broadcast(funds), F.col("symbol") == F.col("sector_etf")).select("score_date", "horizon", "sector", F.col("ret").alias("fund_ret"))
    spy = own.filter("symbol = 'SPY'").select("score_date", "horizon", F.col("ret").alias("spy_ret"))
    each = watch.selectExpr("*", f"inline(array({horizons}))").join(fund, ["score_date", "horizon", "sector"], "left").join(spy, ["score_date", "horizon"], "left")
    each = each.selectExpr("*", f"horizon = {C.HORIZONS[0]} AS first_horizon", "CASE WHEN fund_ret IS NOT NULL AND spy_ret IS NOT NULL THEN own_ret END AS ret")
    rows, grouped = Observation("rows"), Observation("grouped")
    seen = each.observe(rows, *(F.expr(x).alias(k) for k, x in _COUNTS.items())).filter("ret IS NOT NULL")
    groups = seen.selectExpr("horizon", "ret", "ret - fund_ret AS vs_sector", f"explode(array_distinct(split({ACTION_GROUPS.replace('primary_', 'primary')}, '[|]'))) AS grp").observe(grouped, F.count(F.lit(1)).alias("grouped_observations"))
    path = f"{store.shared_folder(m.spark)}/market/summary-{uuid.uuid4().hex}"
    groups.groupBy("grp", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("vs_sector").alias("mean_vs_sector")).write.parquet(path)
    counts = {k: rows.get.get(k, 0) for k in _COUNTS} | {"grouped_observations": grouped.get.get("grouped_observations", 0)}
    return m.spark.read.parquet(path), m.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


def row_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters with one sector that has no fund."""
    m = Tested(spark, sf_dir)
    return counted_summary(m, m.actions().filter(f"rank <= {C.WATCHLIST}"), m.funds.filter("sector <> 'ASIA'"))[1]


_WATCHED = f"(SELECT * FROM x_action WHERE rank <= {C.WATCHLIST})"
_FORWARD = f"(SELECT w.* FROM {_WATCHED} w JOIN x_fwd f ON f.symbol = w.symbol AND f.date = w.score_date JOIN x_fund_fwd u ON u.score_date = w.score_date AND u.sector = w.sector AND u.horizon = f.horizon WHERE w.sector <> 'ASIA')"
_COUNTERS_SQL = f"SELECT *, {len(C.HORIZONS)} * watchlist_rows - forward_observations AS skipped_missing FROM (SELECT count(*) AS watchlist_rows, count(*) FILTER (WHERE extended_leader) AS extended_rows, count(*) FILTER (WHERE {_USEFUL}) AS useful_review_rows, count(*) FILTER (WHERE labels = '{NONE}') AS unclassified_rows, count(*) FILTER (WHERE catalyst <> '{C.PENDING}') AS event_rows, count(*) FILTER (WHERE catalyst = '{C.PENDING}') AS pending_rows FROM {_WATCHED}), (SELECT count(*) AS forward_observations, CAST(sum(len(list_distinct(string_split({ACTION_GROUPS}, '|')))) AS BIGINT) AS grouped_observations FROM {_FORWARD})"

# ---- snapshot files ----------------------------------------------------------------


def documents(m: Labelled) -> DataFrame:
    """(score_date, json): a day's regime, macro flags, sectors, industries, watchlist and stocks; a day has as many of each as it stores."""

    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy("score_date").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias(name))

    stocks = m.actions().withColumn("labels", F.split("labels", r"\|"))
    out = m.regime().select("score_date", F.struct("label", "base_label", "context", "score").alias("regime")).join(m.flags().select("score_date", F.struct(F.filter(F.split("flags", r"\|"), lambda x: x != "").alias("active"), "n_series", "n_stale").alias("macro")), "score_date", "left")
    for part in (listed(m.sectors(), "sectors", "sector", "score", "rank_change"), listed(m.industries(), "industries", "sector", "industry", "score"), listed(stocks.filter(f"rank <= {C.WATCHLIST}"), "watchlist", "symbol", "name", "sector", "industry", "score", "catalyst", "primary", "labels"), listed(stocks, "stocks", "symbol", "score", "trend_state")):
        out = out.join(part, "score_date", "left")
    empty = lambda c: F.coalesce(c, F.array()).alias(c)
    return out.select("score_date", F.to_json(F.struct("score_date", "regime", "macro", *(empty(c) for c in ("sectors", "industries", "watchlist", "stocks")))).alias("json"))


def export(m: Labelled, path: str, screened: DataFrame | None = None) -> None:
    """dashboard/score_date=.../ with a document a day, dates/, latest/ and screener/sector=.../, each written by tasks.

    Days are split over tasks and written by partition; screened needs sector and ticker.
    """
    docs = documents(m)
    kept = f"{path}/_documents"
    docs.repartitionByRange("score_date").write.parquet(kept)
    docs = m.spark.read.parquet(kept)
    docs.write.partitionBy("score_date").text(f"{path}/dashboard")
    last = docs.agg(F.max("score_date").alias("score_date"))
    docs.join(F.broadcast(last), "score_date").select("json").coalesce(1).write.text(f"{path}/latest")  # one document
    docs.agg(F.to_json(F.struct(F.sort_array(F.collect_list("score_date"), asc=False).alias("dates")))).write.text(f"{path}/dates")  # a date a day
    if screened is not None:
        rows = screened.select("sector", F.to_json(F.struct(*screened.columns)).alias("json"))
        rows.repartitionByRange("sector").write.partitionBy("sector").text(f"{path}/screener")


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of every day, read back: their regime, how much they list, and who comes first."""
    path = f"{store.shared_folder(spark)}/market/export-{uuid.uuid4().hex}"
    export(Labelled(spark, sf_dir), path)
    text = spark.read.text(f"{path}/dashboard")
    schema = "regime struct<label: string>, macro struct<active: array<string>>, sectors array<struct<rank: int, sector: string>>, industries array<struct<rank: int, industry: string>>, watchlist array<struct<rank: int, symbol: string, primary: string>>, stocks array<struct<rank: int, symbol: string>>"
    d = text.select("score_date", F.from_json("value", schema).alias("d"))
    latest = spark.read.text(f"{path}/latest").select(F.get_json_object("value", "$.score_date").cast("date").alias("score_date"), F.lit(True).alias("latest"))
    dates = spark.read.text(f"{path}/dates").select(F.explode(F.from_json("value", "dates array<date>")["dates"]).alias("score_date"))
    out = d.select("score_date", F.col("d.regime.label").alias("regime"), F.array_join("d.macro.active", "|").alias("flags"), *(F.size(f"d.{c}").cast("long").alias(f"n_{c}") for c in ("sectors", "industries", "watchlist", "stocks")), F.coalesce(F.col("d.sectors")[0]["sector"], F.lit("")).alias("best_sector"), F.array_join(F.transform("d.watchlist", lambda w: F.concat_ws(":", w["symbol"], w["primary"])), ",").alias("watchlist"))
    return out.join(dates, "score_date").join(F.broadcast(latest), "score_date", "left").withColumn("latest", F.coalesce("latest", F.lit(False)))  # one row


_n = lambda t: f"(SELECT count(*) FROM {t} AS x WHERE x.score_date = d.score_date)"
_EXPORT_SQL = f"SELECT d.score_date, g.label AS regime, f.flags, {_n('x_sectors')} AS n_sectors, {_n('x_industries')} AS n_industries, {_n('x_top')} AS n_watchlist, {_n('x_stocks')} AS n_stocks, coalesce((SELECT sector FROM x_sectors AS x WHERE x.score_date = d.score_date AND rank = 1), '') AS best_sector, coalesce(w.watchlist, '') AS watchlist, d.score_date = (SELECT max(score_date) FROM x_dates) AS latest FROM x_dates d JOIN x_regime g ON g.score_date = d.score_date JOIN x_flags f ON f.score_date = d.score_date LEFT JOIN (SELECT score_date, string_agg(symbol || ':' || primary_, ',' ORDER BY rank) AS watchlist FROM x_action WHERE rank <= {C.WATCHLIST} GROUP BY score_date) w ON w.score_date = d.score_date"

QUERIES = {
    "j15_kept_catalysts": kept_catalysts,
    "q12_stored_labels": stored_labels,
    "j14_event_sectors": event_sectors,
    "u02_merged_watchlists": merged_watchlists,
    "a10_row_counters": row_counters,
    "k09_snapshot_files": exported,
}
ORACLE = {
    "j15_kept_catalysts": with_(_KEPT_SQL),
    "q12_stored_labels": with_(_STORED_SQL),
    "j14_event_sectors": with_("SELECT event_id, e.symbol, coalesce(s.sector, '') AS sector FROM x_events e LEFT JOIN (SELECT symbol, arg_min(sector, (score_date, rank)) AS sector FROM x_stocks WHERE rank <= 5 GROUP BY symbol) s ON s.symbol = e.symbol"),
    "u02_merged_watchlists": with_("SELECT symbol, score_date, rank, sector FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE quarter(score_date) WHEN 4 THEN 0 WHEN 2 THEN 1 ELSE 2 END, score_date, rank) AS no FROM x_top WHERE quarter(score_date) IN (4, 2, 1)) WHERE no = 1"),
    "a10_row_counters": with_(_COUNTERS_SQL),
    "k09_snapshot_files": with_(_EXPORT_SQL),
}
