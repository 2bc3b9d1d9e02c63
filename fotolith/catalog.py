"""The library's registered queries and their SQL, gathered from the plans."""

from __future__ import annotations

from fotolith.plans import context, duplicates, groups, jobs, measure, pairs, ratings, revisions, similarity, state, training, views

_PLANS = (context, duplicates, groups, jobs, measure, pairs, ratings, revisions, similarity, state, training, views)
QUERIES = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in _PLANS for k, v in p.ORACLE_SQL.items()}
