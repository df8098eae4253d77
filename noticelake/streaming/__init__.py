"""Streaming of the notice engine."""
