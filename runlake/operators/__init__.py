"""Transformations of runs and incidents, DataFrame in and DataFrame out."""
