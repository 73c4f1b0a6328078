"""rillhouse: a layered e-commerce warehouse as Spark DataFrame and Structured Streaming jobs."""
