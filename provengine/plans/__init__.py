"""All registered queries of the library."""

from . import check_queries, flow_queries, ledger_queries, project_queries, scalar_queries, stats_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
