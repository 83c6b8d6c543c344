"""Column functions: text, URLs, features and similarity."""
