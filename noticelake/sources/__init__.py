"""Sources of the notice engine."""
