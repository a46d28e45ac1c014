"""Queries over the tables of a data folder, each a composition of the package's operators."""

from thetaloom.plans import abilities, items, ledger, prediction, retrieval, test_taking  # noqa: F401
from thetaloom.plans.registry import ORACLES, QUERIES  # noqa: F401
