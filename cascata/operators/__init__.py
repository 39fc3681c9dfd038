"""Operators on graphs, possible worlds, seeds and removal orders."""
