"""functions of the assurance engine."""
