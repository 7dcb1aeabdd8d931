"""Column functions; all stay inside generated code."""
