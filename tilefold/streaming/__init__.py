"""Structured Streaming forms of operators. The tools whose operators this library covers have no streams."""
