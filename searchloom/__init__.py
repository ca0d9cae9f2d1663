"""searchloom: full-text retrieval and analytics as Spark plans."""
