"""quietlake: privacy masking and LLM-traffic analytics as Spark jobs."""
