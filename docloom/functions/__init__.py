"""Column functions: text, names and places, pairs of records."""
