"""Signals that keep arriving."""
