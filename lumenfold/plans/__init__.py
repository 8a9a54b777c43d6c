"""Cubes planned over the star schema's tables."""
