"""Arrays from tables."""
