"""Queries over dictionaries of news keywords and list pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import news as nw
from ..sources import adapters as src
from .sqltext import r, rs


def dictionary(spark, d):
    """Words of four and more letters of the benchmark's texts; sign and category from the first text that has them and their length."""
    each = src.table(spark, d, "benchmark").select("item_id", F.explode(nw.words(F.col("text"))).alias("keyword")).where(F.length("keyword") >= 4)
    category = F.element_at(F.array(*(F.lit(name) for name, _ in nw.CATEGORIES)), (F.length("keyword") % 6 + 1).cast("int"))
    return each.groupBy("keyword").agg(F.min("item_id").alias("item_id")).select(
        "keyword", F.when(F.col("item_id") % 3 == 0, 1).when(F.col("item_id") % 3 == 1, -1).otherwise(0).alias("sign"), F.when(F.length("keyword") % 6 < len(nw.CATEGORIES), category).alias("category")
    )


def hits(spark, d):
    return nw.keyword_hits(src.table(spark, d, "documents").select("doc_id", "text"), dictionary(spark, d), "doc_id")


def announcement_classes(spark, d):
    out = nw.classify_announcements(hits(spark, d))
    return out.select("doc_id", "n_positive", "n_negative", F.concat_ws(",", "categories").alias("categories"), "direction", "event_type", r("impact").alias("impact"))


def industry_events(spark, d):
    """How many documents have a keyword that is part of an industry's name, or has it as a part; industries are the benchmark's long words."""
    known = dictionary(spark, d).select(F.col("keyword").alias("tag"))
    industries = known.where("length(tag) >= 9").select(F.col("tag").alias("industry"))
    events = src.table(spark, d, "documents").select("doc_id", nw.words(F.col("text")).alias("tags"))
    return nw.events_of_industries(events, industries, "doc_id", known=known).groupBy("industry").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def list_pages(spark, d):
    """One list page a customer, an item an order, in four layouts: date as text, in the address as folders or digits, or none."""
    o = src.table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    title = F.concat(F.lit("Order &amp; notice "), k.cast("string"))
    link = lambda href, extra="": F.concat(F.lit(f'<a class="x" {extra}href="'), href, F.lit('">'), title, F.lit("</a>"))
    item = (
        F.when(k % 4 == 0, F.concat(F.lit("<li>"), link(F.lit("/n.html")), F.lit("<span>"), F.date_format(day, "yyyy/M/d"), F.lit("</span></li>")))
        .when(k % 4 == 1, F.concat(F.lit("<tr><td>"), link(F.concat(F.lit("a/"), F.date_format(day, "yyyyMMdd"), F.lit("1200/i"))), F.lit("</td></tr>")))
        .when(k % 4 == 2, F.concat(F.lit("<dd>"), link(F.concat(F.lit("http://other.example/"), F.date_format(day, "yyyyMM"), F.lit("/i")), 'title="" '), F.lit("</dd>")))
        .otherwise(F.concat(F.lit("<li>"), link(F.lit("javascript:go()")), F.lit("</li>")))
    )
    body = F.array_join(F.sort_array(F.collect_list(item)), "")
    return o.groupBy(F.col("o_custkey").alias("page_id")).agg(body.alias("html")).withColumn("url", F.concat(F.lit("https://list.example/c/"), F.col("page_id").cast("string"), F.lit("/index.html")))


def listing_items(spark, d):
    return nw.listing_items(list_pages(spark, d)).select("page_id", "title", "href", "date")


WORDS = """list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}]+'), lambda w: w <> ''))"""
HITS = f"""kw AS (
  SELECT keyword, CASE min(item_id) % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS sign,
    CASE length(keyword) % 6 {' '.join(f"WHEN {k} THEN '{name}'" for k, (name, _) in enumerate(nw.CATEGORIES))} END AS category
  FROM (SELECT item_id, unnest({WORDS}) AS keyword FROM benchmark) WHERE length(keyword) >= 4 GROUP BY keyword
), tk AS (SELECT doc_id, unnest({WORDS}) AS keyword FROM documents), hit AS (SELECT doc_id, kw.* FROM tk JOIN kw ON kw.keyword = tk.keyword)"""
QUERIES = {"announcement_classes": announcement_classes, "industry_events": industry_events, "listing_items": listing_items}
SQL = {
    "announcement_classes": f"""WITH {HITS}, g AS (
  SELECT d.doc_id, count(*) FILTER (WHERE sign > 0) AS p, count(*) FILTER (WHERE sign < 0) AS n, coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)), ','), '') AS c
  FROM documents d LEFT JOIN hit h ON h.doc_id = d.doc_id GROUP BY 1
), k AS (SELECT *, CASE {' '.join(f"WHEN c LIKE '%{name}%' THEN '{name}'" for name, _ in nw.CATEGORIES)} ELSE 'announcement' END AS event_type FROM g)
SELECT doc_id, p AS n_positive, n AS n_negative, c AS categories, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS direction, event_type,
  {rs(f"greatest(1, least(5, 2.0 + least(2.6, p * 0.6 + n * 0.7) + CASE event_type {' '.join(f'''WHEN '{name}' THEN {more}''' for name, more in nw.CATEGORIES)} ELSE 0 END))")} AS impact FROM k""",
    "industry_events": f"""WITH {HITS}, i AS (SELECT keyword AS industry FROM kw WHERE length(keyword) >= 9),
m AS (SELECT DISTINCT kw.keyword, industry FROM kw JOIN i ON contains(industry, kw.keyword) OR contains(kw.keyword, industry))
SELECT industry, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM hit JOIN m ON m.keyword = hit.keyword GROUP BY 1""",
    "listing_items": """SELECT o_custkey AS page_id, 'Order & notice ' || o_orderkey AS title,
  CASE o_orderkey % 4 WHEN 0 THEN 'https://list.example/n.html' WHEN 1 THEN 'https://list.example/c/' || o_custkey || '/a/' || strftime(o_orderdate, '%Y%m%d') || '1200/i' ELSE 'http://other.example/' || strftime(o_orderdate, '%Y%m') || '/i' END AS href,
  CASE WHEN year(o_orderdate) < 2000 THEN NULL WHEN o_orderkey % 4 = 2 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS date FROM orders WHERE o_orderkey % 4 <> 3""",
}
