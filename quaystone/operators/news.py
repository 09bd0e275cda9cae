"""News by dictionaries: an inverted keyword index joined by token, announcement classes, events of industries, list pages.

A dictionary is a table (keyword, sign, category); texts meet it by equality of words, so work does not grow with the
number of keywords as it does with one ``contains`` each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_text
from ..sources.shared import written

# Categories of announcements in order of precedence, and what each adds to the impact.
CATEGORIES = (("earnings_notice", 0.5), ("capital_action", 0.4), ("business_order", 0.5), ("regulatory_risk", 0.8))
BASE_IMPACT, MOST_HITS, PER_POSITIVE, PER_NEGATIVE = 2.0, 2.6, 0.6, 0.7
#: Shortest title of a list page's item.
MIN_TITLE = 8


def words(text: Column) -> Column:
    """Distinct lower-case words: runs of letters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != ""))


def keyword_hits(news: DataFrame, dictionary: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per row of ``news`` (by ``key``): how many positive and negative keywords occur, their categories and the keywords, both sorted.

    ``dictionary``: keyword, sign (1, -1 or 0), category (null: none); a keyword listed twice counts once a sign.  Rows without a
    hit are there with zeros.
    """
    tokens = news.select(key, F.explode(words(F.col(text))).alias("keyword"))
    found = tokens.join(dictionary.select("keyword", "sign", "category").distinct(), "keyword").groupBy(key).agg(
        F.count_distinct(F.when(F.col("sign") > 0, F.col("keyword"))).alias("n_positive"), F.count_distinct(F.when(F.col("sign") < 0, F.col("keyword"))).alias("n_negative"),
        F.sort_array(F.collect_set("category")).alias("categories"), F.sort_array(F.collect_set("keyword")).alias("keywords"),
    )
    out = news.join(found, key, "left").fillna(0, ["n_positive", "n_negative"])
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("categories", "keywords")})


def classify_announcements(hit: DataFrame) -> DataFrame:
    """``hit`` with direction, event_type and impact (1 to 5): the first category in order of precedence decides."""
    p, n = F.col("n_positive"), F.col("n_negative")
    kind, extra = None, None
    for name, more in CATEGORIES:
        has = F.array_contains("categories", name)
        kind = F.when(has, name) if kind is None else kind.when(has, name)
        extra = F.when(has, more) if extra is None else extra.when(has, more)
    impact = BASE_IMPACT + F.least(F.lit(MOST_HITS), p * PER_POSITIVE + n * PER_NEGATIVE) + extra.otherwise(0.0)
    return hit.withColumns({
        "direction": F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral"), "event_type": kind.otherwise("announcement"),
        "impact": F.greatest(F.lit(1.0), F.least(F.lit(5.0), impact)),
    })


def announcements(items: DataFrame, base: str) -> DataFrame:
    """Vendor rows (announcementTitle, announcementTime in epoch milliseconds, adjunctUrl, secCode, secName) as events of level ``stock``.

    Rows without a title are dropped; relative addresses are joined to ``base``.
    """
    path = F.coalesce("adjunctUrl", F.lit(""))
    out = items.select(
        F.lit("stock").alias("event_level"), F.lit("official_announcement").alias("source_type"), clean_text("announcementTitle").alias("title"),
        F.timestamp_millis(F.col("announcementTime").try_cast("long")).alias("publish_time"), F.when(path.rlike("^https?://"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(path, F.lit("/")))).alias("url"),
        F.coalesce(F.col("secCode").cast("string"), F.lit("")).alias("symbol"), F.coalesce("secName", F.lit("")).alias("symbol_name"), F.lit(0.99).alias("confidence"),
    )
    return out.where("title <> ''")


def pieces(name: Column) -> Column:
    """All substrings of a name; names are short."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.transform(F.sequence(F.lit(1), F.length(name) - i + 1), lambda n: F.substring(name, i, n)))))


def industries_of_tags(tags: DataFrame, industries: DataFrame) -> DataFrame:
    """(tag, industry) where one contains the other; both are dimensions of short names, and meet by equality of substrings."""
    t, i = tags.where("tag <> ''").select("tag").distinct(), industries.where("industry <> ''").select("industry").distinct()
    inside = i.select("industry", F.explode(pieces(F.col("industry"))).alias("tag")).join(t, "tag")
    around = t.select("tag", F.explode(pieces(F.col("tag"))).alias("industry")).join(i, "industry")
    return inside.select("tag", "industry").union(around.select("tag", "industry")).distinct()


def events_of_industries(events: DataFrame, industries: DataFrame, key: str, tags: str = "tags", known: DataFrame | None = None) -> DataFrame:
    """(industry, key) of every event with a tag that matches the industry; only tags in ``known`` (tag) count, where that is given.

    The matches are written once, so that the events are read once and Spark knows how small the matches are.
    """
    each = events.select(key, F.explode(tags).alias("tag"))
    matches = written(industries_of_tags(each if known is None else known, industries), "industries-of-tags")
    return each.join(matches, "tag").select("industry", key).distinct()


def listing_items(pages: DataFrame, *, least_title: int = MIN_TITLE) -> DataFrame:
    """(page_id, title, href, date) of the items of list pages, several layouts in one scan.

    An item is a list entry, a table row or a definition; its first link counts.  The title is the link's ``title``, else its text; the
    date is the first in the item's text, else that in the address (a folder of 8 or 6 digits, or spelt out), else null.  Short titles and
    script links go; a page's first item of a title stays.
    """
    blocks = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<(li|tr|dd)\b[^>]*>.*?</\1>"), F.lit(0)))
    rows = pages.where("html is not null").select("page_id", "url", blocks).withColumn("a", F.regexp_extract("col", r"(?is)<a\s[^>]*?>.*?</a>", 0)).where("a <> ''")
    href = F.coalesce(F.nullif(F.regexp_extract("a", r"(?is)\bhref\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract("a", r"(?is)\bhref\s*=\s*'([^']*)'", 1))
    title = F.coalesce(F.nullif(clean_text(F.regexp_extract("a", r"(?is)\btitle\s*=\s*\"([^\"]*)\"", 1)), F.lit("")), clean_text(F.regexp_extract("a", r"(?is)>(.*?)</a>", 1)))
    rows = rows.select("page_id", "url", "pos", F.trim(href).alias("href"), title.alias("title"), F.regexp_replace("col", r"(?is)<[^>]*>", " ").alias("text"))
    rows = rows.where((F.length("title") >= least_title) & (F.col("href") != "") & ~F.col("href").startswith("#") & ~F.lower("href").startswith("javascript"))
    day = lambda c, pattern, parts: F.try_to_date(F.concat_ws("-", *(F.lpad(F.regexp_extract(c, pattern, k), 2, "0") if k > 1 else F.regexp_extract(c, pattern, k) for k in range(1, parts + 1)), *([F.lit("01")] if parts == 2 else [])), "yyyy-MM-dd")
    spelt = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"
    date = F.coalesce(day("text", spelt, 3), day("href", spelt, 3), day("href", r"/(20\d{2})(\d{2})(\d{2})\d*(?:/|$)", 3), day("href", r"/(20\d{2})(\d{2})/", 2))
    site, folder = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.regexp_extract("url", r"^(https?://[^?#]*/)", 1)
    full = F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(site, "href")).otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.concat(site, F.lit("/"))), "href"))
    rows = rows.select("page_id", "title", full.alias("href"), date.alias("date"), "pos")
    return rows.groupBy("page_id", "title").agg(F.min_by(F.struct("href", "date"), "pos").alias("i")).select("page_id", "title", "i.href", "i.date")
