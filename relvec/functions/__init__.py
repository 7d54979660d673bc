"""Column functions: scalars, vectors, probabilities."""
