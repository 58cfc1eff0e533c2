"""Operators for training corpora: de-duplication, quality, tokens, mixing, formatting."""
