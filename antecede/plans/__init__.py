"""Whole jobs and the mapping of the driver tables to the pitch tables."""
