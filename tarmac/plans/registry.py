"""Imports every query module so that ``REGISTRY`` is complete."""

from __future__ import annotations

from tarmac.plans import (  # noqa: F401
    queries_columns,
    queries_ingest,
    queries_joins,
    queries_kpi,
    queries_ml,
    queries_network,
    queries_nlq,
    queries_schedule,
)
from tarmac.plans.catalog import REGISTRY  # noqa: F401
