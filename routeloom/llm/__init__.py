"""Training-data operators: similarity joins, scans, classifiers, tokenisation, search.

Nothing outside this subpackage imports it.
"""
