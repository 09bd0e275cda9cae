"""Pick snapshots kept as JSON: schema on read with drifting and broken fields, versions, action matching, pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, parse_date
from .store import latest_by

#: Scalar columns beside the JSON; they stand in where the JSON does not name them.
SCALARS = ("pick_id", "user_id", "trade_date", "symbol", "name", "strategy_code", "risk_level", "created_at")
NUMBERS = ("score", "ranking_score", "swing_score", "continuation_score", "risk_control_score", "leader_score", "theme_rank_score", "up_prob", "dd_prob", "expected_edge_pct", "profit_factor_proxy")
BREAKDOWN = ("total", "ranking_score", "swing_score", "continuation_score", "risk_control_score", "theme", "trend", "money_flow", "turnover_liquidity")
SIGNALS = ("volume_ratio_20", "rsi", "ma20_gap_pct")
BUYS = ("paper_buy", "buy", "simulated_buy")
NO_RANK = 999999


def of_strings(names) -> str:
    return "struct<" + ", ".join(f"{n}: string" for n in names) + ">"


#: Leaves are read as text, so that a number written as text, or a word where a number was, breaks no other field.
SCHEMA = (
    "struct<" + ", ".join(f"{n}: string" for n in (*SCALARS, "rank_no", *NUMBERS)) + f", score_breakdown: {of_strings(BREAKDOWN)}, ranking_diagnostics: struct<signal_features: {of_strings(SIGNALS)}>, "
    f"market_state: {of_strings(('state_tag', 'state_score'))}, evidence_summary: {of_strings(('state_tag',))}, user_action: {of_strings(('action_type', 'was_bought', 'buy_action_time', 'created_at'))}, _broken: string>"
)
#: Columns of a candidate row that are numbers: where each is looked for, in order; 0 where nowhere.
FACTORS = {
    "ranking_score": ("ranking_score", "score_breakdown.ranking_score"), "swing_score": ("swing_score", "score_breakdown.swing_score"), "continuation_score": ("continuation_score", "score_breakdown.continuation_score"),
    "risk_control_score": ("risk_control_score", "score_breakdown.risk_control_score"), "leader_score": ("leader_score",), "theme_rank_score": ("theme_rank_score", "score_breakdown.theme"),
    "up_prob": ("up_prob",), "dd_prob": ("dd_prob",), "expected_edge_pct": ("expected_edge_pct",), "profit_factor_proxy": ("profit_factor_proxy",), "total_score": ("score_breakdown.total", "score"),
    "trend": ("score_breakdown.trend",), "money_flow": ("score_breakdown.money_flow",), "turnover_liquidity": ("score_breakdown.turnover_liquidity",),
    "volume_ratio_20": ("ranking_diagnostics.signal_features.volume_ratio_20",), "rsi": ("ranking_diagnostics.signal_features.rsi",), "ma20_gap_pct": ("ranking_diagnostics.signal_features.ma20_gap_pct",),
}


def write_snapshots(df: DataFrame, path: str, by: str) -> None:
    """Snapshot rows (SCALARS and snapshot_json) as JSON lines, one folder a value of ``by``."""
    df.select(*SCALARS, "snapshot_json", by).write.partitionBy(by).json(path)


def read_snapshots(spark, path: str, by: str) -> DataFrame:
    """Snapshot rows below ``path``; a filter on ``by`` reads its folders alone."""
    return spark.read.schema(", ".join(f"{n} string" for n in (*SCALARS, "snapshot_json", by))).json(path)


def number(*paths: str, default: float | None = 0.0) -> Column:
    """The first of the paths that holds a finite number."""
    found = [finite(F.col(p).try_cast("double")) for p in paths]
    return F.coalesce(*found, *([] if default is None else [F.lit(default)]))


def parsed(rows: DataFrame) -> DataFrame:
    """``pick``: the snapshot with its missing scalars filled in; ``broken``: whether its JSON could not be read, or only in part."""
    text = F.coalesce("snapshot_json", F.lit("{}"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    out = rows.withColumn("pick", F.from_json(text, SCHEMA, options))
    out = out.withColumn("broken", F.col("pick").isNull() | F.col("pick._broken").isNotNull() | ~F.startswith(F.ltrim(text), F.lit("{")))
    out = out.withColumn("pick", F.when(~F.col("broken"), F.col("pick")))
    fill = {n: F.coalesce(F.col(f"pick.{n}"), F.col("symbol") if n == "name" and "name" not in rows.columns else F.col(n)) for n in SCALARS}
    fill["name"] = F.coalesce(fill["name"], F.col("symbol"))
    rest = ["rank_no", *NUMBERS, "score_breakdown", "ranking_diagnostics", "market_state", "evidence_summary", "user_action"]
    return out.withColumn("pick", F.struct(*(v.alias(k) for k, v in fill.items()), *(F.col(f"pick.{n}").alias(n) for n in rest)))


def newest_versions(rows: DataFrame) -> DataFrame:
    """One row a pick_id: the version written last."""
    return latest_by(rows, ["pick_id"], "created_at", "snapshot_json")


def quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, versions that a later one replaced, broken rows and rows without a rank, per key."""
    p = parsed(rows)
    return p.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("pick_id")).alias("n_replaced"), F.count_if("broken").alias("n_broken"),
        F.count_if(F.col("pick.rank_no").try_cast("int").isNull()).alias("n_unranked"),
    )


def action_history(actions: DataFrame, key: str) -> DataFrame:
    """Per key: type and time of the latest action, whether any action was a buy, the first buy's time and the first action's id."""
    buy = F.col("action_type").isin(*BUYS)
    return actions.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(
        F.max_by("action_type", "id").alias("action_type"), F.coalesce(F.bool_or(buy), F.lit(False)).alias("was_bought"),
        F.min_by(F.when(buy, F.col("created_at")), F.when(buy, F.col("id"))).alias("buy_action_time"), F.min("id").alias("first_id"),
    )


def candidate_rows(snapshots: DataFrame, actions: DataFrame) -> DataFrame:
    """Flat candidate rows of parsed snapshots, each with its action: its own, else its pick's, else that of its symbol's first acted pick.

    ``actions``: id, pick_id, symbol, action_type, created_at.  A buy at any time counts, even if a later action closed it.
    """
    by_pick = action_history(actions, "pick_id")
    symbols = actions.where("pick_id <> ''").groupBy("pick_id").agg(F.max_by("symbol", "id").alias("symbol"))
    parts = ("action_type", "was_bought", "buy_action_time")
    whole = lambda prefix: F.struct(*(F.col(c).alias(c) for c in parts)).alias(prefix)
    by_symbol = by_pick.join(symbols, "pick_id").where("symbol <> ''").groupBy("symbol").agg(F.min_by(F.struct(*parts), "first_id").alias("_s"))
    df = parsed(snapshots).select("pick", "broken").select("pick.*", "broken")
    df = df.join(by_pick.select("pick_id", whole("_p")), "pick_id", "left").join(by_symbol, "symbol", "left")
    own = F.col("user_action.action_type").isNotNull() | F.col("user_action.was_bought").isNotNull()
    stored = F.coalesce("_p", "_s")
    own_buy = F.coalesce(F.lower("user_action.was_bought") == "true", F.lit(False)) | F.coalesce(F.col("user_action.action_type").isin(*BUYS), F.lit(False))
    bought = F.when(own, own_buy).otherwise(F.coalesce(stored["was_bought"], F.lit(False)))
    time = F.when(own, F.coalesce("user_action.buy_action_time", F.when(F.col("user_action.action_type").isin(*BUYS), F.col("user_action.created_at")))).otherwise(stored["buy_action_time"])
    day = F.date_format(parse_date(F.col("trade_date")), "yyyy-MM-dd")
    return df.select(
        F.coalesce(day, F.col("trade_date")).alias("trade_date"), "pick_id", "symbol", "name", "strategy_code", "risk_level", F.coalesce(F.col("rank_no").try_cast("int"), F.lit(NO_RANK)).alias("rank_no"), number("score", "score_breakdown.total").alias("score"),
        F.coalesce("market_state.state_tag", "evidence_summary.state_tag", F.lit("unknown")).alias("market_state_tag"), number("market_state.state_score").alias("market_state_score"),
        bought.alias("was_bought"), F.when(bought, time).alias("buy_action_time"), F.when(own, F.col("user_action.action_type")).otherwise(stored["action_type"]).alias("action_type"), "broken",
        *(number(*paths).alias(f"factor_{name}") for name, paths in FACTORS.items()),
    )


def snapshot_dates(rows: DataFrame, limit: int = 30) -> DataFrame:
    """The newest dates that have snapshots, in one spelling (a top-n report)."""
    d = parse_date(F.col("trade_date"))
    return rows.select(d.alias("trade_date")).where("trade_date is not null").distinct().orderBy(F.desc("trade_date")).limit(max(1, min(limit, 365)))


def pick_history(rows: DataFrame, *, strategy: str = "", risk: str = "", start=None, end=None) -> DataFrame:
    """Candidate rows of a strategy, a risk level and a span of dates; an empty condition holds for all."""
    for column, value in (("strategy_code", strategy), ("risk_level", risk)):
        rows = rows.where(F.col(column) == value) if value else rows
    rows = rows.where(F.col("trade_date") >= start) if start else rows
    return rows.where(F.col("trade_date") <= end) if end else rows


def latest_pool(rows: DataFrame, limit: int = 60) -> DataFrame:
    """The best ranked candidates of the newest date (a top-n report), with their place."""
    newest = rows.agg(F.max("trade_date").alias("trade_date"))  # one row
    top = rows.join(F.broadcast(newest), "trade_date").orderBy("rank_no", "pick_id").limit(limit)
    return top
