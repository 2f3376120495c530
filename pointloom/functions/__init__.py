"""Column functions: vectors, curves, colours, geometry."""
