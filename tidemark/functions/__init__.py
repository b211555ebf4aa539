"""Column functions; every one is a built-in expression, so it stays inside code generation."""
