"""Operators for preparing text corpora at scale. Nothing outside this folder imports it."""
