"""fiscora: layered financial-filing analytics expressed as Spark jobs."""
