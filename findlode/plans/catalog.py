"""All queries by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from findlode.plans import activity, links, meta, more, shape, text, vector
from findlode.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "activity", "links", "meta", "more", "shape", "text", "vector"]
