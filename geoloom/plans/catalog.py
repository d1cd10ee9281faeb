"""The registered queries and their SQL counterparts, gathered from the query modules."""

from __future__ import annotations

from geoloom.plans import connectors, hexagons, learning, models, relational, spatial  # noqa: F401  (they register their queries)
from geoloom.plans.inputs import QUERIES, SQL

FLAGSHIP = "tile_category_counts"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
