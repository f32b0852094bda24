"""The registered queries: importing the modules fills the registry."""

from . import facts, modeled, records, screening  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
