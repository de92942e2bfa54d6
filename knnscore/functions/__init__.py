"""Column functions: features of a transaction, quantization, distances, evaluation scores."""
