"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this subpackage.  Every operator module has a
general DataFrame interface; ``queries`` holds the thin registered queries and
``oracles`` their DuckDB statements.
"""
