"""Every registered query of the library's own operators, with its oracle SQL."""

from __future__ import annotations

from docloom.plans import answer_plans, evidence_plans, match_plans, record_plans, relational_plans, search_plans, streaming_plans, structure_plans, text_plans, tree_plans  # noqa: F401  they register their queries
from docloom.plans.registry import ORACLES, QUERIES, Query
from docloom.plans.search_plans import flagship  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
