"""Composite jobs, and the queries registered with their SQL."""
