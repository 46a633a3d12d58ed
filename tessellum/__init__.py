"""Document indexing and hybrid retrieval on Spark: many documents and many queries at a time."""
