"""Search-visibility analytics as Spark jobs."""
