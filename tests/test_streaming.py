"""Bars and triggers of streams against the batch plans over the same ticks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewheel.operators import merge
from tidewheel.plans import intraday, sessions
from tidewheel.streaming import bars

DAY = dt.datetime(2031, 3, 3, 9)


def made_ticks(seed=2):
    rng = random.Random(seed)
    out = []
    for n, (symbol, day) in enumerate((s, d) for s in ("ORCA", "TERN", "WREN") for d in range(2)):
        price = 30.0
        for k in range(900):
            price *= 1 + rng.gauss(0, 0.0006)
            out.append((symbol, DAY + dt.timedelta(days=day, seconds=k * 30 + rng.randint(0, 29)), price, float(rng.choice([0, 100, 200, 900])) if n else 0.0, k))
    return out


def test_bars_of_a_stream_equal_the_batch_after_late_ticks(spark, tmp_path):
    ticks = sorted(made_ticks(), key=lambda t: t[1])
    rng = random.Random(4)
    ticks = sorted(ticks, key=lambda t: t[1] + dt.timedelta(minutes=rng.choice([0, 0, 10, 25])))  # some come late, but in time
    whole = spark.createDataFrame(ticks, bars.TICK)
    folder, path = f"{tmp_path}/ticks", f"{tmp_path}/bars"
    stream = lambda: bars.store_bars(bars.bars(bars.ticks_of(spark, folder), "5Min"), path, f"{tmp_path}/checkpoint").awaitTermination(120)
    cuts = [0, 2000, 3500, len(ticks)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(ticks[a:b], bars.TICK).coalesce(1).write.mode("append").parquet(folder)
        assert stream()
    # a tick of days ago is too late and changes nothing; one of the next day closes all windows
    spark.createDataFrame([("ORCA", DAY, 999.0, 5.0, -1), ("ORCA", DAY + dt.timedelta(9), 1.0, 1.0, 0)], bars.TICK).coalesce(1).write.mode("append").parquet(folder)
    assert stream()
    got = merge.read(spark, path).filter(F.col("date") < F.lit(DAY.date() + dt.timedelta(8)))
    want = bars.bars(whole, "5Min")
    columns = ["symbol", "ts", "date", "timeframe", "slot", "open", "high", "low", "close", "volume"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.count() > 500


def test_triggers_of_a_stream_equal_the_batch(spark, tmp_path):
    key = ["symbol", "date", "timeframe"]
    made = bars.bars(spark.createDataFrame(made_ticks(), bars.TICK), "5Min")
    made = made.selectExpr("*", "CAST(row_number() OVER (PARTITION BY symbol, date ORDER BY slot) - 1 AS INT) AS idx", "CAST(count(*) OVER (PARTITION BY symbol, date) AS INT) AS n").persist()
    levels = made.groupBy("symbol", "date").agg(*(F.avg(F.col("close") * (1 + k / 1000)).alias(c) for k, c in enumerate(intraday.LEVELS)))
    batch = intraday.triggers(made.withColumns({"ac": F.lit(1.0), "atr20": F.lit(1.0)}), levels, tuple(key), ("symbol", "date"), {"5Min": bars.range_bars(intraday.RANGE_MINUTES, "5Min")})
    want = {(*r[:4], r.slot, round(r.level, 9), round(r.spike, 9)) for r in batch.collect()}
    levelled = made.join(levels, ["symbol", "date"]).select(*[c.split()[0] for c in bars.BAR.split(", ")])
    folder = f"{tmp_path}/levelled"
    for lo, hi in ((0, 111), (111, 130), (130, 150), (150, 288)):
        levelled.filter((F.col("slot") >= lo) & (F.col("slot") < hi)).coalesce(1).write.mode("append").parquet(folder)
        found = bars.first_triggers(spark.readStream.schema(bars.BAR).parquet(folder), "5Min")
        assert found.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/found").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    got = [(*r[:4], r.slot, round(r.level, 9), round(r.spike, 9)) for r in spark.read.schema(bars.FOUND).parquet(f"{tmp_path}/found").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({g[3] for g in got}) >= 3
    made.unpersist()


def test_sessions_do_not_see_another_day(spark):
    """The same bars on two days and in two timeframes give each session the one result."""
    one = [(k, 20.0 + k / 100, 19.9, 20.0, 400.0) for k in range(6)] + [(6, 21.0, 20.0, 20.9, 900.0)]
    rows = [("S", d, t, k, k, 7, h, h, lo, c, v, 20.0, 0.1) for d in ("2031-01-01", "2031-01-02") for t in sessions.TIMEFRAMES for k, h, lo, c, v in one]
    df = spark.createDataFrame(rows, "symbol string, date string, timeframe string, slot int, idx int, n int, open double, high double, low double, close double, volume double, ac double, atr20 double").withColumn("date", F.to_date("date"))
    profiles = intraday.volume_profile(df, sessions.SESSION).collect()
    assert len(profiles) == 4 and {(r.total, r.poc, r.vwap) for r in profiles} == {(3300.0, profiles[0].poc, profiles[0].vwap)}
    levels = df.select("symbol", "date").distinct().withColumns({c: F.lit(3.0) for c in intraday.LEVELS})
    found = intraday.triggers(df, levels, sessions.SESSION, ("symbol", "date"), sessions.RANGES).collect()
    assert {(r.date.day, r.timeframe, r.trigger_type, r.slot) for r in found} == {(d, t, k, 6) for d in (1, 2) for t in sessions.TIMEFRAMES for k in ("orb_breakout", "hod_break")}
