"""Scalar and aggregate functions of the analytics layer."""
