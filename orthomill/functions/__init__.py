"""Column-level functions: ids, arrays, geometry and reprojection."""
