"""loomrank: staged content-ranking analytics expressed as Spark DataFrame plans."""
