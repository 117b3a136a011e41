"""Queries over the driver's tables, one or more per operator."""

from catalogue import changes, documents, ledger, scalars  # noqa: F401
from catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
