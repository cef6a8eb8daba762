"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``queries`` applies them to the sample tables.
"""
