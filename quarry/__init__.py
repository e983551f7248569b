"""Quarry: exact text search, record integration and corpus preparation on Spark."""
