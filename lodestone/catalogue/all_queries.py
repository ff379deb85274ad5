"""Every query of the engine outside the optional subpackage."""

from . import chunks, graphs, judging, lexical, stores, tables, vectors  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
