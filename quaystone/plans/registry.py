"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from . import q_data, q_guidance, q_indicators, q_learning, q_live, q_news, q_pools, q_ranking, q_replay, q_reports, q_rules, q_scores, q_snapshots, q_trades

_PARTS = (q_indicators, q_ranking, q_rules, q_trades, q_data, q_scores, q_reports, q_pools, q_live, q_replay, q_learning, q_snapshots, q_news, q_guidance)
QUERIES: dict = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL: dict = {name: s for part in _PARTS for name, s in part.SQL.items()}
