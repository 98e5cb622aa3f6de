"""Relational operators on visibilities, grids, kernels and images."""
