"""Column functions: text, JSON documents, names and endpoint lines."""
