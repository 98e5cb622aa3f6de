"""Radio-interferometric imaging on Spark DataFrames.

Visibilities, antennas, uv-grids, kernels and images are DataFrames; every
operator takes DataFrames and returns a lazy DataFrame.
"""

from fringelake.model import GridSpec

__all__ = ["GridSpec"]
