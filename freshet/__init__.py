"""Freshet: flood-risk analytics as DataFrame -> DataFrame operators on Spark.

Subpackages: ``functions`` (column expressions), ``sources`` (scans and sinks),
``operators`` (joins, aggregations, windows, grids, graphs, metrics),
``plans`` (composite jobs and the registered queries), ``streaming``.
"""
