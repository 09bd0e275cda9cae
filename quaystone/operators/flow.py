"""Money flow by tier, and news events: extraction, keyword rules, decay scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, content_hash, freshness, hits, safe_div


def tier_summary(flow: DataFrame, keys=("symbol",)) -> DataFrame:
    """Net per tier, main net and control ratio, trend and strength."""
    signed = F.when(F.col("side") == "buy", F.col("amount")).otherwise(-F.col("amount"))
    big = F.col("tier").isin("super_large", "large")
    out = flow.groupBy(*keys).agg(
        *(F.sum(F.when(F.col("tier") == t, signed).otherwise(0.0)).alias(f"{t}_net") for t in ("super_large", "large", "medium", "small")),
        F.sum(F.when(big, signed).otherwise(0.0)).alias("main_net"), F.sum(F.when(big, F.col("amount")).otherwise(0.0)).alias("main_turnover"),
    )
    ratio = F.coalesce(safe_div(F.abs("main_net"), "main_turnover"), F.lit(0.0)) * 100
    out = out.withColumn("control_ratio", ratio)
    return out.withColumns({
        "trend": F.when(F.col("main_net") > 0, "inflow").when(F.col("main_net") < 0, "outflow").otherwise("balanced"),
        "strength": F.when(F.col("control_ratio") >= 10, "strong").when(F.col("control_ratio") >= 5, "medium").otherwise("weak"),
    })


def last_days(df: DataFrame, n: int) -> DataFrame:
    """Rows of each symbol's ``n`` most recent dates."""
    return df.withColumn("_d", F.dense_rank().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("_d") <= n).drop("_d")


def flow_estimate(bars: DataFrame) -> DataFrame:
    """Price and volume up: +0.3 of the amount; price down: -0.2; else 0; summed per symbol."""
    w = Window.partitionBy("symbol").orderBy("date")
    dc, dv = F.col("close") - F.lag("close").over(w), F.col("volume") - F.lag("volume").over(w)
    e = F.when((dc > 0) & (dv > 0), 0.3 * F.col("amount")).when(dc < 0, -0.2 * F.col("amount")).otherwise(0.0)
    return bars.withColumn("_e", e).groupBy("symbol").agg(F.sum("_e").alias("estimate"))


def listing(pages: DataFrame) -> DataFrame:
    """Links of list pages: (page_id, title, href), titles of at least 2 characters, one row per page and title."""
    anchors = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"), F.lit(0)))
    rows = pages.select("page_id", "url", anchors.alias("a"))
    rows = rows.select("page_id", F.concat(F.regexp_extract("url", r"^(https?://[^/]+)", 1), F.regexp_extract("a", r'href="([^"]*)"', 1)).alias("href"), clean_text(F.regexp_extract("a", r"(?is)>(.*?)</a>", 1)).alias("title"))
    return rows.where(F.length("title") >= 2).groupBy("page_id", "title").agg(F.min("href").alias("href"))


def classify(news: DataFrame, good: list[str], bad: list[str], key: list[str]) -> DataFrame:
    """Direction, impact and signed event score from distinct keyword hits in ``text``."""
    n = news.withColumns({"pos": hits("text", good), "neg": hits("text", bad), "key": hits("text", key) > 0})
    impact = 2.2 + F.least(F.lit(2.5), 0.55 * F.col("pos") + 0.65 * F.col("neg")) + F.when(F.col("key"), 0.8).otherwise(0.0)
    n = n.withColumn("impact", F.greatest(F.lit(1.0), F.least(F.lit(5.0), impact)))
    direction = F.when(F.col("pos") > F.col("neg"), "positive").when(F.col("pos") < F.col("neg"), "negative").otherwise("neutral")
    n = n.withColumn("direction", direction)
    sign = F.when(F.col("direction") == "positive", 1).when(F.col("direction") == "negative", -1).otherwise(0)
    return n.withColumn("event_score", sign * F.col("impact") * 0.8 * 10)


def with_hash(news: DataFrame) -> DataFrame:
    return news.withColumn("content_hash", content_hash("source", "title", "url"))


def tags_of(news: DataFrame, tags: dict[str, list[str]], most: int = 4) -> DataFrame:
    """The first ``most`` tags, in their order, with any keyword in the text."""
    found = F.array_compact(F.array(*(F.when(hits("text", words) > 0, tag) for tag, words in tags.items())))
    return news.withColumn("tags", F.slice(found, 1, most))


def decayed_score(events: DataFrame, key: str, age_hours: str, horizon: float = 168.0) -> DataFrame:
    """Sum of event scores weighted by freshness, clamped to +-40, per key."""
    s = F.sum(F.col("event_score") * freshness(age_hours, horizon))
    return events.groupBy(key).agg(F.count("*").alias("n_events"), F.greatest(F.lit(-40.0), F.least(F.lit(40.0), s)).alias("net")).withColumn("display", 50 + F.col("net"))


def diverse_top(events: DataFrame, n: int, group: str, by: str = "source", time: str = "age_hours") -> DataFrame:
    """Top ``n`` per group: first one of each source, newest first, then the rest."""
    src = Window.partitionBy(group, by).orderBy(time, "doc_id")
    e = events.withColumn("_s", F.row_number().over(src) > 1)
    w = Window.partitionBy(group).orderBy("_s", time, "doc_id")
    return e.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).drop("_s")


def news_filter(news: DataFrame, *, keyword: str | None = None, source: str | None = None, relevant_only: bool = False, level: str | None = None, symbol: str | None = None, since=None) -> DataFrame:
    """Conjunction of the given conditions; ``level``, ``symbol`` and ``since`` read event_level, symbol and publish_time."""
    out = news
    for column, value in (("event_level", level), ("symbol", symbol)):
        out = out.where(F.col(column) == value) if value else out
    if since is not None:
        out = out.where(F.col("publish_time") >= F.lit(since))
    if keyword:
        out = out.where(F.lower("text").contains(keyword.lower()))
    if source:
        out = out.where(F.col("source") == source)
    if relevant_only:
        out = out.where((F.abs("event_score") > 0.01) | (F.col("impact") >= 2.8))
    return out
