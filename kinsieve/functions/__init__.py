"""Column functions: words, ids, crash reports."""
