"""All registered queries; importing this module registers them."""

from rosterforge.plans import queries_analytics, queries_joins, queries_lineups, queries_matches, queries_reports, queries_search  # noqa: F401
from rosterforge.plans.registry import ORACLE, QUERIES  # noqa: F401
