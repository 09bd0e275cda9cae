"""Column functions: safe numbers, dates, symbols, keyword rules.  All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and infinities become null."""
    x = c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_float(x, default: float = 0.0) -> Column:
    return F.coalesce(finite(F.expr(f"try_cast({x} as double)") if isinstance(x, str) else x), F.lit(float(default)))


def clamp(x, lo: float, hi: float) -> Column:
    """Bounded; null and non-finite become ``lo``.  Reads ``x`` twice only, as steps built on steps are written out in full."""
    x = F.nanvl(c(x).cast("double"), F.lit(None).cast("double"))
    return F.when(x < float("inf"), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))).otherwise(float(lo))


def bound(x: Column, lo: float, hi: float) -> Column:
    """Bounded; reads ``x`` once, so that steps built on steps stay small.  ``x`` must not be null."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def safe_div(a, b, default: float | None = None) -> Column:
    out = finite(F.try_divide(c(a), c(b)))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def truthy(cond: Column) -> Column:
    """Comparisons with null are false."""
    return F.coalesce(cond, F.lit(False))


def or_default(x, default: float) -> Column:
    """Zero counts as missing."""
    return F.coalesce(F.nullif(c(x), F.lit(0.0)), F.lit(float(default)))


def parse_date(x) -> Column:
    x = c(x).cast("string")
    return F.coalesce(
        F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(x, 1, 8), "yyyyMMdd"), F.try_to_date(x, "yyyy/MM/dd")
    )


def parse_event_time(x) -> Column:
    """Epoch seconds or milliseconds, compact digits, dashed, slashed and dotted dates."""
    x = F.trim(c(x).cast("string"))
    number = F.when(x.rlike(r"^\d{9,13}$"), x.cast("double"))
    epoch = F.timestamp_seconds(F.when(number > 1e10, number / 1000).otherwise(number))
    flat = F.regexp_replace(F.regexp_replace(x, "[年月/.]", "-"), "[日T]", " ")
    tries = [F.try_to_timestamp(F.when(x.rlike(rf"^\d{{{len(p)}}}$"), x), F.lit(p)) for p in ("yyyyMMdd", "yyyyMMddHHmm", "yyyyMMddHHmmss")]
    tries += [F.try_to_timestamp(F.trim(flat), F.lit(p)) for p in ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d")]
    return F.coalesce(F.when(x.rlike(r"^\d{9,11}$|^\d{13}$"), epoch), *tries)


def parse_unit_number(x) -> Column:
    """First signed decimal of a text; commas and % go, a ten-thousand unit scales to the hundred-million unit."""
    x = F.trim(c(x).cast("string"))
    bare = F.regexp_replace(x, "[,%]", "")
    value = F.nullif(F.regexp_extract(bare, r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double")
    return F.round(F.when(bare.endswith("万"), value / 10000).otherwise(value), 4)


def valid_symbol(x) -> Column:
    return truthy(c(x).rlike("^[036][0-9]{5}$"))


def excluded_name(x) -> Column:
    x = F.coalesce(c(x), F.lit(""))
    return (F.trim(x) == "") | F.upper(x).contains("ST") | x.contains("退")


def board(x) -> Column:
    x = c(x)
    return (
        F.when(x.startswith("688"), "star").when(x.startswith("300") | x.startswith("301"), "growth").when(x.startswith("60"), "main_sh")
        .when(x.startswith("00"), "main_sz").when(x.startswith("8") | x.startswith("4"), "north").otherwise("other")
    )


def exchange_code(x) -> Column:
    x = c(x)
    tail = F.when(x.startswith("6"), ".SH").when(x.startswith("0") | x.startswith("3"), ".SZ").otherwise(".BJ")
    return F.when(x.contains("."), F.upper(x)).otherwise(F.concat(x, tail))


def symbol_from_pick_id(x) -> Column:
    return F.try_element_at(F.filter(F.split(c(x), "-"), lambda p: p.rlike(r"^\d{6}$")), F.lit(-1))


def clean_text(x) -> Column:
    """Tags out, the common character references decoded, white space collapsed."""
    x = F.regexp_replace(F.coalesce(c(x), F.lit("")), r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def content_hash(*parts) -> Column:
    return F.sha1(F.concat_ws("|", *(F.coalesce(c(p).cast("string"), F.lit("")) for p in parts)))


def hits(text, words: list[str]) -> Column:
    """How many distinct words occur in the text."""
    return reduce(lambda a, b: a + b, [truthy(c(text).contains(w)).cast("int") for w in words])


def freshness(age_hours, horizon: float = 168.0) -> Column:
    a = c(age_hours)
    return (
        F.when(a.isNull(), 0.45).when(a <= 12, 1.0).when(a <= 24, 0.88).when(a <= 72, 0.72).when(a <= horizon, 0.52).when(a <= 720, 0.28).otherwise(0.12)
    )


def limit_band(symbol) -> Column:
    s = c(symbol)
    return F.when(s.startswith("300") | s.startswith("301") | s.startswith("688"), 19.5).otherwise(9.8)


def search_score(symbol, name, amount, query) -> Column:
    """Rank of a listing for a query text; null where it does not match."""
    s, n, q = c(symbol), F.upper(c(name)), F.upper(F.trim(c(query)))
    at_s, at_n = F.instr(s, q), F.instr(n, q)
    base = (
        F.when(s == q, 1200.0).when(n == q, 1150.0).when(s.startswith(q), 1020.0 - F.length(s)).when(at_s > 0, 920.0 - 5 * (at_s - 1))
        .when(n.startswith(q), 980.0 - F.length(n)).when(at_n > 0, 860.0 - 8 * (at_n - 1))
    )
    return base + F.least(F.lit(60.0), safe_div(amount, F.lit(1e8), 0.0))
