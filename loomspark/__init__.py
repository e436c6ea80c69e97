"""Analytics over conversations and documents, as Spark DataFrame operators."""
