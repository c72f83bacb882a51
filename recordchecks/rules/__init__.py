"""Fixed rule tables kept as data."""
