"""Scalar Column helpers: text, numbers, dates, identifiers. All native Spark expressions."""
