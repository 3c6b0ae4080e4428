"""All registered queries of the library (the training-data operators register their own)."""

from tessera.plans import categories, extract, folds, grids, groups, headlines, joins, lists, measures, more, ordered, portal, readers, refresh, releases, requests, search, sqlsurface, state, stores, streams, texts  # noqa: F401  registers them
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
