"""Queries over the given tables, one per operator, with SQL counterparts."""

from workload.registry import ORACLES, QUERIES  # noqa: F401
from workload import (  # noqa: F401
    aggregates, columns, joins, models, plans, scalars, sources, streams, windows)
