"""Column functions: text, record parsing, token sequences."""
