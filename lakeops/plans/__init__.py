"""Whole jobs: diagnosing many tables, running a control table's flows."""
