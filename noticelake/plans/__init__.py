"""Plans of the notice engine."""
