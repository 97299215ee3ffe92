"""Named queries of the manuscript audit, each over whole tables, with the SQL that gives the same rows."""

from .audit import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
