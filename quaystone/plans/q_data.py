"""Queries over money flow, news, keyed tables, model metrics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import flow as fl
from ..operators import models as ml
from ..operators import store as st
from ..sources import adapters as src
from ..sources.adapters import BARS, INDUSTRY, MONEY_FLOW, TRADES
from ..streaming import jobs
from .sqltext import r, rs

GOOD, BAD, KEY = ["and", "der", "les"], ["idiot", "###", "!!"], ["the"]
TAGS = {"english": ["the ", "and "], "german": ["der ", "und "], "french": ["les ", "une "], "spanish": ["que ", "los "]}


# money flow
def money_flow(spark, d):
    out = fl.tier_summary(fl.last_days(src.money_flow(spark, d), 60))
    return out.select("symbol", *(r(c, 2).alias(c) for c in ("super_large_net", "large_net", "medium_net", "small_net", "main_net", "control_ratio")), "trend", "strength")


def sector_flow(spark, d):
    f = src.money_flow(spark, d).join(src.industry(spark, d).select("symbol", "industry"), "symbol")
    out = fl.tier_summary(f, ["industry"]).withColumn("main_net", F.round(F.col("main_net"), 2))
    return out.orderBy(F.desc("main_net"), "industry").limit(10).select("industry", r("main_net", 2).alias("main_net"), "trend")


def flow_estimate(spark, d):
    return fl.flow_estimate(src.bars(spark, d)).select("symbol", r("estimate", 2).alias("estimate"))


# news: documents as events; age from the id
def news(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumns({"title": F.substring("text", 1, 40), "url": F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), "age_hours": (F.col("doc_id") % 1000).cast("double")})


def classified(spark, d):
    return fl.classify(news(spark, d), GOOD, BAD, KEY)


def news_events(spark, d):
    n = fl.tags_of(classified(spark, d), TAGS)
    return n.select("doc_id", "direction", "pos", "neg", r("impact").alias("impact"), r("event_score").alias("event_score"), F.concat_ws(",", "tags").alias("tags"))


def news_scores(spark, d):
    return fl.decayed_score(classified(spark, d), "source", "age_hours").select("source", "n_events", r("net", 3).alias("net"), r("display", 3).alias("display"))


def news_diverse(spark, d):
    return fl.diverse_top(classified(spark, d), 8, "lang").select("lang", "pos", "doc_id", "source")


def news_hashes(spark, d):
    return fl.with_hash(news(spark, d)).select("doc_id", "content_hash")


def news_search(spark, d):
    return fl.news_filter(classified(spark, d), keyword="idiot", relevant_only=True).select("doc_id", "source", r("event_score").alias("event_score"))


def page_links(spark, d):
    return fl.listing(src.table(spark, d, "pages")).select("page_id", "title", "href")


# keyed tables over orders
def orders(spark, d):
    return src.table(spark, d, "orders")


def latest_orders(spark, d):
    return st.latest_by(orders(spark, d), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


def upserted(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_orderstatus", r("o_totalprice", 2).alias("price"))
    new = o.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") + 5).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), "price")
    return st.upsert(o, new.dropDuplicates(["o_orderkey"]), ["o_orderkey"])


def inserted(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") * 3).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))
    return st.insert_missing(o, new, ["o_orderkey"])


def active_orders(spark, d):
    return st.single_active(orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "is_active")


def preferred(spark, d):
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"))
    c = src.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return st.prefer(s, c, ["k"])


def source_fallback(spark, d):
    """A symbol's supplier bars, or else the closes of the part of that number; of parts that share it, the price of the greatest trade number, of equal ones the highest."""
    b = src.bars(spark, d).select("symbol", "date", r("close").alias("close"))
    parts = src.numbered_trades(spark, d).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("price", F.struct("seq", "price")).alias("close"))
    return st.first_source([b, parts.select("symbol", "date", r("close").alias("close"))], "symbol")


def order_quotes(spark, d):
    b = src.bars(spark, d).select("symbol", F.col("date").alias("bar_date"), r("close").alias("close"))
    req = orders(spark, d).select("o_orderkey", F.format_string("%06d", "o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("at"))
    out = st.as_of(req, b, "symbol", "at", "bar_date")
    return out.select("o_orderkey", "symbol", "at", F.col("found_bar_date").alias("bar_date"), F.col("found_close").alias("close"), F.datediff("at", "found_bar_date").cast("double").alias("age_days"))


def paged(spark, d):
    return st.page(orders(spark, d).select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 50, 100).select("o_orderkey")


def searched(spark, d):
    i = src.industry(spark, d)
    s = i.withColumn("score", sc.search_score("symbol", "name", F.col("s_acctbal") * 1e6, F.lit("00001"))).where("score is not null")
    return s.select("symbol", "name", r("score").alias("score")).orderBy(F.desc("score"), "symbol").limit(20)


def scalars(spark, d):
    p = src.table(spark, d, "part").withColumn("code", F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0"))
    return p.select(
        "p_partkey", "code", sc.board("code").alias("board"), sc.exchange_code("code").alias("exchange"), sc.valid_symbol("code").alias("valid"), sc.excluded_name("p_name").alias("excluded"),
        sc.symbol_from_pick_id(F.concat_ws("-", F.lit("pick"), "code", F.lit("x"))).alias("from_id"), r(sc.clamp(F.col("p_retailprice"), 950, 1000)).alias("clamped"),
        sc.parse_unit_number(F.concat(F.lit("1,"), F.col("p_size").cast("string"), F.lit("00.5%"))).alias("number"), sc.limit_band("code").alias("band"),
    )


def dates(spark, d):
    o = orders(spark, d).withColumn("d", F.to_date("o_orderdate"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("d", "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("d", "yyyy-MM-dd")).otherwise("bad")
    return o.select("o_orderkey", sc.parse_date(text).alias("parsed"))


# model metrics: y from labels, p from text length
def predictions(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    p = F.round(1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 2000.0)), 4)
    return src.table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), p.alias("p"))


def model_metrics(spark, d):
    e = ml.evaluate(predictions(spark, d), ["lang"]).join(ml.calibration_error(predictions(spark, d), ["lang"]), "lang")
    return e.select("lang", "n", "n_pos", *(r(c).alias(c) for c in ("brier", "log_loss", "auc", "ece")))


def bands(spark, d):
    return ml.probability_bands(predictions(spark, d), ["lang"]).select("lang", "band", "n", r("hit_rate").alias("hit_rate"))


def neighbours(spark, d):
    e = src.table(spark, d, "embeddings").where("embedding is not null")
    return ml.neighbour_evidence(e.where("vec_id % 50 = 0"), e).select("vec_id", "n", r("avg_d", 3).alias("avg_d"), "nearest", r("mean_label").alias("mean_label"))


# streams
def stream(spark, d):
    return jobs.event_stream(spark, f"{d}/events.parquet")


def stream_latest(spark, d):
    out = jobs.run_available(jobs.latest_per_key(stream(spark, d), "user_id", "ts", "value"), spark, "update", ["user_id"])
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), r("value").alias("value"))


def stream_dedupe(spark, d):
    out = jobs.run_available(jobs.deduplicated(stream(spark, d).select("event_id", "ts", "event_type"), ["event_id"], "ts"), spark, "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def stream_bars(spark, d):
    out = jobs.run_available(jobs.tumbling_bars(stream(spark, d).where("value is not null"), "event_type", "ts", "value"), spark, "update", ["event_type", "start"])
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), *(r(c).alias(c) for c in ("open", "high", "low", "close")), "n")


def stream_positions(spark, d):
    out = jobs.run_available(jobs.running_positions(stream(spark, d)), spark, "update", ["user_id"])
    return out.select("user_id", r("qty").alias("qty"), r("cost", 3).alias("cost"), "n")


QUERIES = {
    "money_flow_tiers": money_flow, "sector_flow_top10": sector_flow, "flow_estimate": flow_estimate,
    "news_events": news_events, "news_scores": news_scores, "news_diverse_top": news_diverse, "news_hashes": news_hashes, "news_search": news_search, "page_links": page_links,
    "latest_order_per_customer": latest_orders, "upsert_orders": upserted, "insert_missing_orders": inserted, "single_active_order": active_orders, "prefer_primary": preferred,
    "source_fallback": source_fallback, "as_of_quotes": order_quotes, "page_of_orders": paged, "search_symbols": searched, "scalar_rules": scalars, "parse_dates": dates,
    "model_metrics": model_metrics, "probability_bands": bands, "neighbour_evidence": neighbours,
    "stream_latest_value": stream_latest, "stream_deduplicated": stream_dedupe, "stream_daily_bars": stream_bars, "stream_positions": stream_positions,
}

hit = lambda words: " + ".join(f"contains(text, '{w}')::INT" for w in words)
NEWS = f"""n0 AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, (doc_id % 1000)::DOUBLE AS age FROM documents),
n1 AS (SELECT *, {hit(GOOD)} AS pos, {hit(BAD)} AS neg, ({hit(KEY)}) > 0 AS key FROM n0),
n2 AS (SELECT *, greatest(1.0, least(5.0, 2.2 + least(2.5, 0.55 * pos + 0.65 * neg) + CASE WHEN key THEN 0.8 ELSE 0 END))::DOUBLE AS impact,
  CASE WHEN pos > neg THEN 'positive' WHEN pos < neg THEN 'negative' ELSE 'neutral' END AS direction FROM n1),
news AS (SELECT *, CASE direction WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END * impact * 0.8 * 10 AS event_score FROM n2)"""
FRESH = "CASE WHEN age <= 12 THEN 1.0 WHEN age <= 24 THEN 0.88 WHEN age <= 72 THEN 0.72 WHEN age <= 168 THEN 0.52 WHEN age <= 720 THEN 0.28 ELSE 0.12 END"
PRED = "pred AS (SELECT l.doc_id, d.lang, l.quality AS y, round(1 / (1 + exp(-(d.n_chars - 1500) / 2000.0)), 4) AS p FROM labels l JOIN documents d USING (doc_id))"
SIGNED = "CASE WHEN side = 'buy' THEN amount ELSE -amount END"
TIER = ", ".join(f"sum(CASE WHEN tier = '{t}' THEN {SIGNED} ELSE 0 END) AS {t}_net" for t in ("super_large", "large", "medium", "small"))
BIG = "tier IN ('super_large', 'large')"
LINK = r"""(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""
CODE = "lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0')"
SQL = {
    "money_flow_tiers": f"""WITH {MONEY_FLOW}, l AS (SELECT * FROM money_flow QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY date DESC) <= 60),
g AS (SELECT symbol, {TIER}, sum(CASE WHEN {BIG} THEN {SIGNED} ELSE 0 END) AS main_net, sum(CASE WHEN {BIG} THEN amount ELSE 0 END) AS t FROM l GROUP BY symbol),
k AS (SELECT *, coalesce(abs(main_net) / nullif(t, 0), 0) * 100 AS control_ratio FROM g)
SELECT symbol, {', '.join(f'{rs(c, 2)} AS {c}' for c in ('super_large_net', 'large_net', 'medium_net', 'small_net', 'main_net', 'control_ratio'))},
  CASE WHEN main_net > 0 THEN 'inflow' WHEN main_net < 0 THEN 'outflow' ELSE 'balanced' END AS trend, CASE WHEN control_ratio >= 10 THEN 'strong' WHEN control_ratio >= 5 THEN 'medium' ELSE 'weak' END AS strength FROM k""",
    "sector_flow_top10": f"""WITH {MONEY_FLOW}, {INDUSTRY}, g AS (SELECT industry, round(sum(CASE WHEN {BIG} THEN {SIGNED} ELSE 0 END), 2) AS m FROM money_flow JOIN industry USING (symbol) GROUP BY industry)
SELECT industry, {rs('m', 2)} AS main_net, CASE WHEN m > 0 THEN 'inflow' WHEN m < 0 THEN 'outflow' ELSE 'balanced' END AS trend FROM g ORDER BY m DESC, industry LIMIT 10""",
    "flow_estimate": f"""WITH {BARS}, e AS (SELECT symbol, amount, close - lag(close) OVER w AS dc, volume - lag(volume) OVER w AS dv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, {rs('sum(CASE WHEN dc > 0 AND dv > 0 THEN 0.3 * amount WHEN dc < 0 THEN -0.2 * amount ELSE 0 END)', 2)} AS estimate FROM e GROUP BY symbol""",
    "news_events": f"""WITH {NEWS} SELECT doc_id, direction, pos::INT AS pos, neg::INT AS neg, {rs('impact')} AS impact, {rs('event_score')} AS event_score,
  concat_ws(',', {', '.join(f"CASE WHEN {hit(w)} > 0 THEN '{t}' END" for t, w in TAGS.items())}) AS tags FROM news""",
    "news_scores": f"WITH {NEWS}, g AS (SELECT source, count(*) AS n_events, greatest(-40.0, least(40.0, sum(event_score * {FRESH}))) AS net FROM news GROUP BY source) SELECT source, n_events, {rs('net', 3)} AS net, {rs('50 + net', 3)} AS display FROM g",
    "news_diverse_top": f"""WITH {NEWS}, s AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY age, doc_id) > 1 AS again FROM news)
SELECT lang, k::INT AS pos, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY again, age, doc_id) AS k FROM s) WHERE k <= 8""",
    "news_hashes": "SELECT doc_id, sha1(concat_ws('|', coalesce(source, ''), left(coalesce(text, ''), 40), 'doc/' || doc_id)) AS content_hash FROM documents",
    "news_search": f"WITH {NEWS} SELECT doc_id, source, {rs('event_score')} AS event_score FROM news WHERE contains(lower(text), 'idiot') AND (abs(event_score) > 0.01 OR impact >= 2.8)",
    "page_links": f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{LINK}')) AS a FROM pages),
b AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_extract(a, 'href="([^"]*)"', 1) AS href,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(a, '(?is)>(.*?)</a>', 1), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM a)
SELECT page_id, title, min(href) AS href FROM b WHERE length(title) >= 2 GROUP BY 1, 2""",
    "latest_order_per_customer": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "upsert_orders": f"""WITH o AS (SELECT o_orderkey, o_orderstatus, {rs('o_totalprice', 2)} AS price FROM orders), n AS (SELECT o_orderkey + 5 AS o_orderkey, 'X' AS o_orderstatus, price FROM o WHERE o_orderkey % 10 = 0)
SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n""",
    "insert_missing_orders": """WITH n AS (SELECT o_orderkey * 3 AS o_orderkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 10 = 0)
SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "single_active_order": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_active FROM orders",
    "prefer_primary": """SELECT coalesce(s.s_suppkey, c.c_custkey) AS k, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, c_name) AS name FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey""",
    "source_fallback": f"""WITH {BARS}, {TRADES}, u AS (SELECT symbol, date, {rs('close')} AS close, 0 AS prio FROM bars
  UNION ALL SELECT symbol, ts::DATE, {rs('arg_max(price, seq)')}, 1 FROM trades GROUP BY 1, 2)
SELECT symbol, date, close FROM u QUALIFY prio = min(prio) OVER (PARTITION BY symbol)""",
    "as_of_quotes": f"""WITH {BARS}, q AS (SELECT o_orderkey, printf('%06d', o_custkey) AS symbol, o_orderdate::DATE AS at FROM orders)
SELECT q.o_orderkey, q.symbol, q.at, b.date AS bar_date, {rs('b.close')} AS close, date_diff('day', b.date, q.at)::DOUBLE AS age_days FROM q ASOF LEFT JOIN bars b ON b.symbol = q.symbol AND b.date <= q.at""",
    "page_of_orders": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 51 OFFSET 100",
    "search_symbols": f"""WITH {INDUSTRY}, s AS (
  SELECT symbol, name, CASE WHEN symbol = '00001' THEN 1200.0 WHEN upper(name) = '00001' THEN 1150.0 WHEN starts_with(symbol, '00001') THEN 1020.0 - length(symbol) WHEN instr(symbol, '00001') > 0 THEN 920.0 - 5 * (instr(symbol, '00001') - 1)
    WHEN starts_with(upper(name), '00001') THEN 980.0 - length(name) WHEN instr(upper(name), '00001') > 0 THEN 860.0 - 8 * (instr(upper(name), '00001') - 1) END + least(60.0, s_acctbal * 1e6 / 1e8) AS score FROM industry
) SELECT symbol, name, {rs('score')} AS score FROM s WHERE score IS NOT NULL ORDER BY {rs('score')} DESC, symbol LIMIT 20""",
    "scalar_rules": f"""WITH p AS (SELECT *, {CODE} AS code FROM part) SELECT p_partkey, code,
  CASE WHEN starts_with(code, '688') THEN 'star' WHEN starts_with(code, '300') OR starts_with(code, '301') THEN 'growth' WHEN starts_with(code, '60') THEN 'main_sh' WHEN starts_with(code, '00') THEN 'main_sz' WHEN code[1] IN ('8', '4') THEN 'north' ELSE 'other' END AS board,
  code || CASE WHEN code[1] = '6' THEN '.SH' WHEN code[1] IN ('0', '3') THEN '.SZ' ELSE '.BJ' END AS exchange, code[1] IN ('0', '3', '6') AS valid,
  trim(coalesce(p_name, '')) = '' OR contains(upper(p_name), 'ST') AS excluded, code AS from_id, {rs('greatest(950.0, least(1000.0, p_retailprice))')} AS clamped,
  round(('1' || p_size || '00.5')::DOUBLE, 4) AS number, CASE WHEN code[1:3] IN ('300', '301', '688') THEN 19.5 ELSE 9.8 END::DOUBLE AS band FROM p""",
    "parse_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate::DATE END AS parsed FROM orders",
    "model_metrics": f"""WITH {PRED}, k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS rk, greatest(0.001, least(0.999, p)) AS c FROM pred),
g AS (SELECT lang, count(*) AS n, sum(y)::BIGINT AS n_pos, avg((p - y) ** 2) AS brier, -avg(y * ln(c) + (1 - y) * ln(1 - c)) AS log_loss, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM k GROUP BY lang),
b AS (SELECT lang, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(y) AS my, avg(p) AS mp FROM pred GROUP BY 1, 2), e AS (SELECT lang, sum(n * abs(my - mp)) / sum(n) AS ece FROM b GROUP BY lang)
SELECT lang, n, n_pos, {', '.join(f'{rs(c)} AS {c}' for c in ('brier', 'log_loss', 'auc', 'ece'))} FROM g JOIN e USING (lang)""",
    "probability_bands": f"WITH {PRED} SELECT lang, ((p >= 0.2)::INT + (p >= 0.4)::INT + (p >= 0.6)::INT + (p >= 0.8)::INT)::INT AS band, count(*) AS n, {rs('avg(y)')} AS hit_rate FROM pred GROUP BY 1, 2",
    "neighbour_evidence": f"""WITH x AS (SELECT vec_id, coalesce(label, 0)::DOUBLE AS label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE embedding IS NOT NULL),
z AS (SELECT vec_id, label, pos, CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE v END AS v FROM x),
s AS (SELECT pos, CASE WHEN stddev_pop(v) >= 1e-6 THEN stddev_pop(v) ELSE 1 END AS sd FROM z GROUP BY pos),
q AS (SELECT a.vec_id, b.vec_id AS other, any_value(b.label) AS label, round(sqrt(avg(((a.v - b.v) / sd) ** 2)) + 1e-9, 6) AS d
  FROM z a JOIN z b ON a.pos = b.pos AND a.vec_id <> b.vec_id JOIN s ON s.pos = a.pos WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS pos FROM q QUALIFY pos <= 40)
SELECT vec_id, count(*) AS n, {rs('avg(d)', 3)} AS avg_d, arg_min(other, pos) AS nearest, {rs('avg(label)')} AS mean_label FROM k GROUP BY vec_id""",
    "stream_latest_value": f"SELECT user_id, max(ts) AS ts, {rs('arg_max(value, (ts, event_id))')} AS value FROM events GROUP BY user_id",
    "stream_deduplicated": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
    "stream_daily_bars": f"""SELECT event_type, date_trunc('day', ts) AS start, {rs('arg_min(value, (ts, event_id))')} AS open, {rs('max(value)')} AS high, {rs('min(value)')} AS low, {rs('arg_max(value, (ts, event_id))')} AS close, count(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY 1, 2""",
    "stream_positions": f"""WITH RECURSIVE e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
p AS (
  SELECT user_id, 0::BIGINT AS k, 0.0::DOUBLE AS q, 0.0::DOUBLE AS c FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.k, CASE WHEN event_type = 'purchase' THEN q + 1 WHEN q > 0 THEN q - 1 ELSE q END,
         CASE WHEN event_type = 'purchase' THEN c + value WHEN q > 0 THEN c * (q - 1) / q ELSE c END
  FROM p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1
) SELECT user_id, {rs('q')} AS qty, {rs('c', 3)} AS cost, k AS n FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
}
