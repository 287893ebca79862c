"""Column expressions: grid names, pixels, reference systems, geometry."""
