"""Answer-grounding analytics on Spark."""
