"""Operators for preparing training data: text in, decisions and digests out."""
