"""Evidence retrieval, linking and corpus preparation as Spark DataFrame operators."""
