"""Whole jobs and the queries that are served."""
