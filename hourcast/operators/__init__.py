"""Operators on time series tables."""
