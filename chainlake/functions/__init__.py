"""functions of chainlake."""
