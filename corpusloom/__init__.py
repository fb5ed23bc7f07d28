"""Property-graph, text and corpus analytics as Spark DataFrame operators."""
