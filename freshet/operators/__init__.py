"""Joins, aggregations, windows, samplers, grids, graphs, metrics and models."""
