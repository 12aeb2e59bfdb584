"""State-machine analytics on Spark."""
