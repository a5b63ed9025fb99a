"""sources of chainlake."""
