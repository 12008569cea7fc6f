"""airq: air-quality analytics written as Spark DataFrame transformations."""
