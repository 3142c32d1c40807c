"""Column functions: cleaning, JSON and arrays, text similarity."""
