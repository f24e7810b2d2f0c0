"""Registered queries."""

from . import iterative, relational
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "iterative", "relational"]
