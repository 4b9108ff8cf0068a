"""Lazy tables."""
