"""Stateful stream processors."""
