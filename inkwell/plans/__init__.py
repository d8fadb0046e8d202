"""Named queries over the given tables, each with its SQL counterpart where one exists."""

from inkwell.plans import intake, learning, profiles, splitting, streams, texts  # noqa: F401
from inkwell.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
