"""Column functions: complex arithmetic, coordinates, scalar helpers."""
