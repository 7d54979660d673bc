"""Whole jobs: feature build, training runs, configuration grids."""
