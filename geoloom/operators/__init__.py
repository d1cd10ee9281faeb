"""Operators over region, feature and joint tables."""
