"""Structured Streaming wiring for the stateless checks."""
