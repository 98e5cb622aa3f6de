"""All registered queries."""

from fringelake.registry import geometry, grids, imaging, planning, sets
from fringelake.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "geometry", "grids", "imaging", "planning", "sets"]
