"""Scalar SQL expressions that Spark and ANSI SQL read alike."""

from __future__ import annotations

from tidewheel import config as C


def clamp(x: str) -> str:
    """x held in 0..100; null stays null."""
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(0.0, least(100.0, {x})) END"


def ratio(a: str, b: str) -> str:
    """a / b, null where b is zero."""
    return f"(({a}) / nullif({b}, 0))"


def distance(a: str, b: str) -> str:
    return f"({ratio(a, b)} - 1)"


def over(call: str, back: int | None = None, ahead: int = 0, by: str = "symbol", order: str = "date") -> str:
    """A window call by symbol in date order; back rows before up to `ahead` rows after (negative: before)."""
    frame = ""
    if back is not None:
        end = "CURRENT ROW" if ahead == 0 else f"{-ahead} PRECEDING" if ahead < 0 else f"{ahead} FOLLOWING"
        start = "UNBOUNDED PRECEDING" if back < 0 else f"{back} PRECEDING"
        frame = f" ROWS BETWEEN {start} AND {end}"
    return f"{call} OVER (PARTITION BY {by} ORDER BY {order}{frame})"


def timeframe_minutes(timeframe: str) -> int:
    """Minutes of a timeframe such as 5Min or 2Hour."""
    for unit, minutes in (("Min", 1), ("Hour", 60)):
        if timeframe.endswith(unit) and timeframe.removesuffix(unit).isdecimal() and int(timeframe.removesuffix(unit)):
            return int(timeframe.removesuffix(unit)) * minutes
    raise ValueError(f"timeframe {timeframe!r} must be a number of Min or Hour, for example 5Min")


def range_bars(minutes: int, timeframe: str) -> int:
    """Bars that cover so many minutes, one at least."""
    return max(1, -(-minutes // timeframe_minutes(timeframe)))


def rel_score(x: str) -> str:
    return clamp(f"{C.NEUTRAL} + {C.RELATIVE_SCALE} * ({x})")


def volume_score(x: str) -> str:
    return clamp(f"(({x}) - {C.VOLUME_BASELINE}) * {C.VOLUME_SCALE}")


def six(x: str) -> str:
    """x to six decimals. Halves go up even where summing in another order left them a bit lower."""
    return f"(floor(({x}) * 1e6 + 0.50001) / 1e6)"


def r6(x: str, alias: str | None = None) -> str:
    return f"{six(x)} AS {alias or x}"


def rank_key(score: str) -> str:
    """Scores that differ by less than summing order explains rank as equal."""
    return f"floor(({score}) * 1e8 + 0.50001)"


def decimals(x: str, places: int, text: str = "STRING") -> str:
    """x as a text with so many decimals, halves away from zero; `text` is the dialect's type of texts."""
    whole = f"CAST(floor(abs({x}) * 1e{places} + 0.50001) AS BIGINT)"
    one = 10**places
    left = f"CAST(CAST(floor({whole} / {one}) AS BIGINT) AS {text})"
    right = f"|| '.' || lpad(CAST({whole} % {one} AS {text}), {places}, '0')" if places else ""
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || {left} {right})"


def percent(x: str, text: str = "STRING") -> str:
    return f"({decimals(f'(({x}) * 100)', 2, text)} || '%')"


def multiple(x: str, text: str = "STRING") -> str:
    return f"({decimals(x, 2, text)} || 'x')"
