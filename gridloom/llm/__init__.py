"""Operators that prepare text, embeddings and web archives for model training."""
