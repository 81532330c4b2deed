"""Column builders: keys, geometry, colour."""
