"""Readers, sinks and input bindings."""
