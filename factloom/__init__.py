"""Temporal fact-graph analytics on Spark."""
