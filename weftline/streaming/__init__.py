"""Event streams."""
