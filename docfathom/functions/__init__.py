"""Column builders: text, hashes, scores."""
