"""Registered queries, one module per area."""

from flowlake.plans import detection, flows, models, streams, tables, training  # noqa: F401
from flowlake.plans.registry import ORACLES, QUERIES  # noqa: F401
