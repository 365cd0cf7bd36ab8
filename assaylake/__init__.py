"""Assay analytics as typed Spark DataFrame operators and named queries."""
