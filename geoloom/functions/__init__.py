"""Column functions: grids, geometry, road attributes and small scalar rules."""
