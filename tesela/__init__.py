"""Document-retrieval analytics as Spark plans."""
