"""Structured Streaming versions of the region aggregates: an extension beyond the batch library."""
