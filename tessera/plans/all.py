"""Importing this module registers every query."""

from tessera.plans import contracts, files, ordered, protocols, relational, statistics  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES, ROWS  # noqa: F401
