"""Column expressions: cleaning, geometry, projections, risk rules. No Python UDFs."""
