"""Property-graph traversals and training-data operators as Spark DataFrame plans."""
