"""operators of chainlake."""
