"""chainlake: on-chain analytics as Spark jobs."""
