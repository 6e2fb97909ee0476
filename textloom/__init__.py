"""textloom: document-segment processing as Spark DataFrame operations."""
