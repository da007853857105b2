"""Operators for large-scale text corpora (training-data preparation).

Nothing else in the library imports this subpackage. ``QUERIES`` and
``ORACLES`` hold its registered queries and their SQL.
"""

from .queries import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
