"""Functions of the notice engine."""
