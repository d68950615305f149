"""Column functions: pure expressions, no actions, no Python workers."""
