"""Operators: layout windows, section discovery, row and block grammars, matching, reconciliation, directory queries."""
