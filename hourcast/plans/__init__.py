"""Compositions of operators: feature plans and jobs."""
