"""starloom: a Spark-first engine for entity canons, similarity maps and corpus work."""
