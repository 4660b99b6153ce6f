"""Structured Streaming forms of the operators that keep state over time."""
