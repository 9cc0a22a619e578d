"""Column expressions: text, path and lexical helpers."""
