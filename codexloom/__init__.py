"""Book-corpus retrieval and reading analytics as Spark DataFrame operators."""
