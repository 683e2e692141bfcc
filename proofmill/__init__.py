"""Evidence conformance analytics on Spark."""
