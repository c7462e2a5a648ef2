"""Operators on text collections for language-model training data. Nothing outside this package imports it."""
