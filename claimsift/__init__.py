"""Document classification analytics as DataFrame-in, DataFrame-out Spark jobs."""
