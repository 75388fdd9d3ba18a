"""Text analytics over whole tables of documents, chunks, vectors and events, as Spark DataFrame operators."""
