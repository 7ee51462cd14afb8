"""Backward as-of join without a join by key: a bar holds until the next one.

Each bar knows the date of its successor, from the window that made its
indicators. It is repeated for the days it holds and those are matched with the
dates asked for, a table of a few thousand rows at most for decades of days, which is
broadcast. So nothing is shuffled again, and no pair of bar and date is ever made
that is not in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel.operators.oracle import cte


def score_dates(bars: DataFrame) -> DataFrame:
    """(score_date): every day of the benchmark that has enough history."""
    return bars.filter((F.col("symbol") == "SPY") & (F.col("bar_idx") >= C.SCORE_START_BAR)).select(F.col("date").alias("score_date"))


def effective(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """bars with score_date, one row for each date at which the bar is its symbol's last."""
    span = dates.agg(F.min("score_date").alias("d0"), F.max("score_date").alias("d1"))
    held = bars.crossJoin(F.broadcast(span)).withColumn("from_", F.greatest("date", "d0")).withColumn("to_", F.least(F.coalesce(F.date_sub("next_date", 1), F.col("d1")), F.col("d1")))
    days = held.filter("from_ <= to_").withColumn("score_date", F.explode(F.sequence("from_", "to_")))
    return days.join(F.broadcast(dates), "score_date").drop("from_", "to_", "d0", "d1")


cte("x_dates", f"SELECT date AS score_date FROM x_bars WHERE symbol = 'SPY' AND bar_idx >= {C.SCORE_START_BAR}")
cte("x_eff", "SELECT p.score_date, b.* FROM (SELECT score_date, symbol AS sym FROM x_dates CROSS JOIN (SELECT DISTINCT symbol FROM x_prices)) p ASOF JOIN x_bars b ON p.sym = b.symbol AND p.score_date >= b.date")
