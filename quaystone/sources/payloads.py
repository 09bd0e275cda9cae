"""Vendor payloads as columns: tilde-separated quote lines, JSON bars, alias maps, unit conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_date, safe_float

#: Canonical bar columns and the vendor spellings they are taken from, in order.
BAR_ALIASES = {
    "date": ["date", "trade_date", "日期"], "open": ["open", "开盘"], "high": ["high", "最高"], "low": ["low", "最低"], "close": ["close", "收盘"],
    "volume": ["volume", "vol", "成交量"], "amount": ["amount", "turnover", "成交额"], "pct_change": ["pct_change", "pct_chg", "涨跌幅"],
}


def normalize_history(df: DataFrame, required=("date", "open", "high", "low", "close", "volume")) -> DataFrame:
    """Canonical names and types; rows without a date go; a table that lacks a required column is refused."""
    found = {c: [a for a in names if a in df.columns] for c, names in BAR_ALIASES.items()}
    if missing := [c for c in required if not found[c]]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    pick = lambda c: F.coalesce(*(F.col(a).cast("string") for a in found[c]))
    cols = [parse_date(pick("date")).alias("date"), *(F.expr(f"try_cast(`_{c}` as double)").alias(c) for c in BAR_ALIASES if c != "date" and found[c])]
    keep = [c for c in df.columns if c == "symbol"]
    wide = df.withColumns({f"_{c}": pick(c) for c in BAR_ALIASES if c != "date" and found[c]})
    return wide.select(*keep, *cols).where("date is not null")


def quote_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``v_..="f0~f1~..."`` to typed quotes; lines with fewer than 35 fields go."""
    f = F.split(F.regexp_extract(column, r'="([^"]*)"', 1), "~")
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    num = lambda x: F.coalesce(x.try_cast("double") if hasattr(x, "try_cast") else x.cast("double"), F.lit(0.0))
    return lines.where(F.size(f) >= 35).select(
        at(2).alias("symbol"), at(1).alias("name"), num(at(3)).alias("price"), num(at(4)).alias("prev_close"), num(at(5)).alias("open"), num(at(6)).alias("volume"),
        num(F.try_element_at(F.split(at(35), "/"), F.lit(3))).alias("amount"), F.try_to_timestamp(at(30), F.lit("yyyyMMddHHmmss")).alias("ts"),
    )


def kline_json(rows: DataFrame, column: str = "payload") -> DataFrame:
    """JSON arrays of [date, open, close, high, low, volume] to bars; short rows and nulls go."""
    bars = rows.withColumn("_k", F.explode(F.from_json(column, "array<array<string>>"))).where("size(_k) >= 6")
    names = ["open", "close", "high", "low", "volume"]
    out = bars.select(*[c for c in rows.columns if c != column], parse_date(F.col("_k")[0]).alias("date"), *(F.expr(f"try_cast(_k[{i + 1}] as double)").alias(c) for i, c in enumerate(names)))
    return out.dropna(subset=["date", *names])


def money_in_yuan(value: Column, unit: Column) -> Column:
    """Ten-thousand and hundred-million units to the base unit."""
    return value * F.when(unit == "wan", 1e4).when(unit == "yi", 1e8).otherwise(1.0)


def normalize_snapshot(df: DataFrame) -> DataFrame:
    """Six-digit symbols with numbers (0 where unreadable) and an industry (default ``unknown``)."""
    bare = F.regexp_replace("symbol", "^(sh|sz|bj)", "")
    numeric = [c for c in ("price", "pct_change", "amount", "turnover") if c in df.columns]
    out = df.withColumn("symbol", bare).where(F.col("symbol").rlike(r"^\d{6}$"))
    out = out.withColumns({c: safe_float(c) for c in numeric})
    return out.withColumn("industry", F.coalesce(F.nullif(F.trim("industry"), F.lit("")), F.lit("unknown"))) if "industry" in df.columns else out.withColumn("industry", F.lit("unknown"))
