"""Constants of the scores, labels and thresholds. Results depend on each."""

from __future__ import annotations

NEUTRAL = 50.0
RELATIVE_SCALE = 500.0
TREND_SCALE = 400.0
VOLUME_BASELINE = 0.5
VOLUME_SCALE = 100.0
MIN_DOLLAR_VOLUME = 20_000_000.0
LIQUIDITY_SCALE = 20.0
STORED_STOCKS = 50
WATCHLIST = 25
HORIZONS = (1, 5, 10, 20, 60)
DECILES = 10
SCORE_START_BAR = 60
PENDING = "pending_source"
NEWS_SOURCE_PREFIX = "alpaca_news"

#: Roles of proxies in the synthetic tables: the six part types.
PROXIES = {"QQQ": "PX_PROMO", "IWM": "PX_SMALL", "DIA": "PX_LARGE", "TLT": "PX_STANDARD", "GLD": "PX_ECONOMY", "USO": "PX_MEDIUM"}

MACRO_SERIES = (
    # id, frequency
    ("VIXCLS", "Daily"),
    ("DGS10", "Daily"),
    ("DGS2", "Daily"),
    ("T10Y2Y", "Daily"),
    ("DFF", "Daily"),
    ("CPIAUCSL", "Monthly"),
    ("UNRATE", "Monthly"),
    ("PAYEMS", "Monthly"),
    ("BAMLC0A0CM", "Daily"),
    ("DTWEXBGS", "Daily"),
    ("WALCL", "Weekly"),
)
MACRO_FLAGS = ("volatility_stress", "rate_pressure", "yield_curve_inversion", "credit_stress", "dollar_pressure", "liquidity_tightening", "inflation_pressure", "labor_cooling")

PRIMARY_ORDER = ("extended_leader", "pullback_leader", "base_compression_candidate", "early_rotation_candidate", "actionable_leader", "event_watch_unconfirmed", "unclassified_leader")
REVIEW_ORDER = ("early_rotation_candidate", "base_compression_candidate", "pullback_leader", "actionable_leader", "extended_leader", "event_watch_unconfirmed", "unclassified_leader")
SECTOR_COMPONENTS = ("return_5d", "return_20d", "return_60d", "relative_return_vs_spy", "relative_volume", "breadth", "rank_change")
