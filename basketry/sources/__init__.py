"""Canonical tables, their loaders and a binding to the sample tables."""
