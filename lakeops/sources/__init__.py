"""Readers: commit logs, file inventories, control tables, workspace exports."""
