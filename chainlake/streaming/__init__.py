"""streaming of chainlake."""
