"""Stored tables and their catalog."""
