"""Cascade resilience analytics on Spark: graphs, possible worlds, seeds and removal orders as DataFrames."""
