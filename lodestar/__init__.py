"""lodestar: document analytics and retrieval expressed as Spark DataFrame plans."""
