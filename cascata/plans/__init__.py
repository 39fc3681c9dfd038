"""Registered queries and their oracles, grouped by topic."""
