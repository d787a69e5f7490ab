"""Scalar functions on texts, tokens and vectors."""
