"""Pieces of the SQL that states each query's result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.adapters import BARS

WIN = "OVER (PARTITION BY symbol ORDER BY date)"


def r(x, digits: int = 4) -> Column:
    """Rounded for output; a hair is added so that ties fall alike everywhere."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + 1e-9, digits) + 0.0


def rs(x: str, digits: int = 4) -> str:
    return f"round(({x}) + 1e-9, {digits}) + 0.0"


def fullsql(agg: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


#: bars -> feat: the feature panel.
FEATURES = BARS + f""",
f1 AS (
  SELECT *, {", ".join(f"{fullsql('avg', 'close', n)} AS ma{n}" for n in (5, 10, 20, 60))},
         {fullsql('stddev_samp', 'close', 20)} AS dev20,
         close / nullif(lag(close) {WIN}, 0) - 1 AS daily, amount / 1e8 AS amount_yi
  FROM bars
), f2 AS (
  SELECT *, coalesce(daily, 0) * 100 AS pct_change, ma20 - 2 * dev20 AS boll_lower, ma20 + 2 * dev20 AS boll_upper, ma20 AS boll_mid FROM f1
), feat AS (
  SELECT symbol, date, open, high, low, close, volume, amount, amount_yi, ma5, ma10, ma20, ma60, boll_mid, boll_upper, boll_lower, pct_change,
    coalesce(close / nullif(lag(close, 5) {WIN}, 0) - 1, 0) * 100 AS return_5d,
    coalesce(close / nullif(lag(close, 20) {WIN}, 0) - 1, 0) * 100 AS return_20d,
    coalesce(lag(pct_change) {WIN}, 0) AS prev_pct_change,
    coalesce(close / nullif(ma20, 0) - 1, 0) * 100 AS ma20_gap_pct, coalesce(close / nullif(ma60, 0) - 1, 0) * 100 AS ma60_gap_pct,
    coalesce(close >= ma5, false)::INT + coalesce(ma5 >= ma10, false)::INT + coalesce(ma10 >= ma20, false)::INT + coalesce(ma20 >= ma60, false)::INT AS ma_alignment,
    coalesce((close - boll_lower) / nullif(boll_upper - boll_lower, 0), 0.5) AS boll_position,
    coalesce(least(greatest(volume / nullif({fullsql('avg', 'volume', 5)}, 0), 0), 8), 1) AS volume_ratio_5,
    coalesce(least(greatest(volume / nullif({fullsql('avg', 'volume', 20)}, 0), 0), 8), 1) AS volume_ratio_20,
    least(greatest(coalesce(amount_yi / nullif({fullsql('avg', 'amount_yi', 20)}, 0), 1), 0.1), 10) * 3 AS turnover_inferred,
    least(greatest(amount_yi * pct_change / 12, -5), 5) AS money_flow_proxy,
    coalesce({fullsql('stddev_samp', 'daily', 20)} * sqrt(252.0) * 100, 0) AS volatility_20d,
    coalesce(close / nullif({fullsql('max', 'high', 20)}, 0) - 1, 0) * 100 AS from_20d_high_pct,
    coalesce(close / nullif({fullsql('min', 'low', 20)}, 0) - 1, 0) * 100 AS from_20d_low_pct,
    coalesce((high - low) / nullif(close, 0), 0) * 100 AS intraday_range_pct
  FROM f2
)"""

FEATURE_NAMES = [
    "return_5d", "return_20d", "prev_pct_change", "ma20_gap_pct", "ma60_gap_pct", "boll_position", "volume_ratio_5", "volume_ratio_20", "turnover_inferred",
    "money_flow_proxy", "volatility_20d", "from_20d_high_pct", "from_20d_low_pct", "intraday_range_pct", "pct_change",
]
