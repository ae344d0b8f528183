"""Plans of the corpus engine: queries over the tables, each with the SQL that says the same."""

from quire.plans import checks, files, ingest, lookup, passages, readers, research, scale, search
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "checks", "files", "ingest", "lookup", "passages", "readers", "research", "scale", "search"]
