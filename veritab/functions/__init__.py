"""Column builders: text, patterns, canonical forms."""
