"""Structured Streaming jobs: append flows, CSV landing, type-1 upserts."""
