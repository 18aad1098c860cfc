"""All registered queries."""

from tidemark.catalog import canonical, estimators, market, relational, responses, streams  # noqa: F401
from tidemark.catalog.registry import ENTRIES

__all__ = ["ENTRIES"]
