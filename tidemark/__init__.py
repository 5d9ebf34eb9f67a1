"""tidemark: storage-traffic analytics as Spark DataFrame plans."""
