"""The named queries: importing this package registers all of them."""

from tidemark.catalog import (  # noqa: F401
    aggregates, features, joins, models, projections, sources, streams, windows,
)
from tidemark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
