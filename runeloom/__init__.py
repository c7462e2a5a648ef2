"""Text-corpus analytics on PySpark: sources, text functions, relational operators and query plans."""
