"""Operators that prepare training data: media, mixing, dedup, classifiers, scans, search, packing, output.

Nothing outside this subpackage imports it.
"""
