"""millrace: batch and streaming Spark jobs over a store of documents."""
