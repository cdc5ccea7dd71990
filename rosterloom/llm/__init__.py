"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own interface; ``registry`` holds the thin queries over the supplied
tables.
"""
