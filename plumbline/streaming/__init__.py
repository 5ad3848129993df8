"""streaming of the assurance engine."""
