"""Column functions: pure expressions, no shuffles."""
