"""plans of the assurance engine."""
