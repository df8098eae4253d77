"""Operators of the notice engine."""
