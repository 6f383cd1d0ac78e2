"""Registered queries over the log operators."""
