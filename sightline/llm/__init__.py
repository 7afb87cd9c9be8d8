"""Operators for preparing very large training corpora."""
