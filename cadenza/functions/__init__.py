"""Column builders: no Python runs on rows."""
