"""Session bars and first triggers of a stream of ticks.

Bars are windowed aggregates behind a watermark: a window is written once the
watermark has passed its end, so ticks that come late, but within `late`, count
and those after it do not. Bars land in a store by month, merged by key; a batch
that is repeated after a failure writes the same rows again.

Triggers are found by keyed state: for each session the bars so far that later
ones are compared with. A session's bars may arrive in several batches; each
batch adds its bars in the order of their slots and gives the triggers that are
first of their type.

A tick is (symbol, ts, price, volume, seq): of equal times the higher seq is the
later one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel.functions.expressions import range_bars, timeframe_minutes
from tidewheel.operators import merge
from tidewheel.plans import intraday as I

TICK = "symbol string, ts timestamp, price double, volume double, seq long"
LATE = "30 minutes"


def bars(ticks: DataFrame, timeframe: str, *, late: str = LATE) -> DataFrame:
    """(symbol, ts, date, timeframe, slot, open, high, low, close, volume): ts is where the bar begins; slot counts bars of the day."""
    minutes = timeframe_minutes(timeframe)
    at = F.struct("ts", "seq")
    made = ticks.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "symbol").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    begin = F.col("w.start")
    slot = F.floor((F.unix_timestamp(begin) % 86400) / (60 * minutes)).cast("int")
    return made.select("symbol", begin.alias("ts"), begin.cast("date").alias("date"), F.lit(timeframe).alias("timeframe"), slot.alias("slot"), "open", "high", "low", "close", "volume")


def store_bars(made: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write finished bars into the store by month at path, by key."""

    def put(batch: DataFrame, _: int) -> None:
        merge.merge(batch.sparkSession, path, batch, ["symbol", "date", "timeframe", "slot"])

    return made.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


# ---- triggers by keyed state -----------------------------------------------------------

BAR = "symbol string, date date, timeframe string, slot int, high double, low double, close double, volume double, poc double, val double, vwap double, ema10 double, ema20 double"
FOUND = "symbol string, date date, timeframe string, trigger_type string, slot int, close double, level double, spike double"
#: The last bars' highs, lows, closes and volumes, oldest first; bars so far, the range's and the day's highs, the mean of the three volumes before the last bar; what is found or ended.
STATE = "highs array<double>, lows array<double>, closes array<double>, volumes array<double>, n int, range_high double, day_high double, before double, over array<string>"


def step(state: tuple, bar, k: int) -> tuple[tuple, list[tuple]]:
    """The state after one more bar and the triggers that fire on it: (type, level, spike).

    The opening range has k bars; a session's last bar closes a shorter range in the
    batch plan, which a stream cannot know, so a session of k bars or fewer has no
    opening-range break here.
    """
    highs, lows, closes, volumes, n, range_high, day_high, before, over = state
    over, out = list(over), []
    levels = (bar.poc, bar.val, bar.vwap, bar.ema10, bar.ema20)
    close_to = lambda x: x is not None and any(v and abs(x / v - 1) <= I.WINDOW for v in levels if v is not None)
    mean = lambda count: sum(volumes[-count:]) / len(volumes[-count:]) if volumes else None
    m3 = mean(3) if n >= 1 else None

    def test(kind: str, where: bool, average: float | None, level: float, hit: bool) -> None:
        if kind in over or not where or average is None:
            return
        if average == 0:
            over.append(kind)
        elif hit and bar.volume / average > I.SPIKE:
            over.append(kind)
            out.append((kind, level, bar.volume / average))

    test("orb_breakout", n >= k, mean(k), range_high, bar.high > range_high and bar.close > range_high)
    test("hod_break", n >= 3, m3, day_high, bar.high > day_high and bar.close > day_high)
    dry = n >= 4 and close_to(closes[-1]) and before is not None and volumes[-1] <= before * I.DRYUP
    test("volume_dryup_confirmation", dry, m3, closes[-1] if closes else 0.0, bool(highs) and bar.close > highs[-1])
    top, low = (max(highs[-3:]), min(lows[-3:])) if n >= 3 else (0.0, 0.0)
    mid = (top + low) / 2
    tight = n >= 3 and mid != 0 and (top - low) / mid <= I.CLUSTER_RANGE and close_to(mid)
    test("micro_cluster_break", tight, m3, top, bar.close > top)
    keep = max(k, 3)
    range_high = max(range_high, bar.high) if n < k else range_high
    new = ([*highs, bar.high][-keep:], [*lows, bar.low][-keep:], [*closes, bar.close][-keep:], [*volumes, bar.volume][-keep:], n + 1, range_high, max(day_high, bar.high), m3, over)
    return new, out


EMPTY: tuple = ([], [], [], [], 0, float("-inf"), float("-inf"), None, [])


def first_triggers(levelled: DataFrame, timeframe: str, *, range_minutes: int = I.RANGE_MINUTES) -> DataFrame:
    """FOUND rows of a stream of BAR rows of one timeframe, each session's first trigger of every type."""
    k = range_bars(range_minutes, timeframe)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else EMPTY
        now = tuple(list(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in now)
        found = []
        rows = pd.concat(list(frames)).sort_values("slot")  # a session's bars of one batch
        for bar in rows.itertuples(index=False):
            now, out = step(now, bar, k)
            found += [(*key, kind, bar.slot, bar.close, level, spike) for kind, level, spike in out]
        state.update(now)
        yield pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])

    return levelled.groupBy("symbol", "date", "timeframe").applyInPandasWithState(run, FOUND, STATE, "append", GroupStateTimeout.NoTimeout)


def ticks_of(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of the ticks that land as parquet files in a folder."""
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
