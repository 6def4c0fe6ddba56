"""Scans, sinks and nested documents."""
