"""strataform."""
