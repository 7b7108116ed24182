"""Batch operators: file statistics, control selection, upsert core, hierarchy, profile."""
