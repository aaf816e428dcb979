"""Column functions: text, ids, scripts, measures."""
