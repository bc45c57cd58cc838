"""Evidence analytics expressed as Spark DataFrame plans."""
