"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from . import insight_queries, market_queries, model_queries, origin_queries, quality_queries, report_queries, review_queries, stream_queries

MODULES = (origin_queries, quality_queries, market_queries, review_queries, stream_queries, report_queries, insight_queries, model_queries)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLES.items()}
