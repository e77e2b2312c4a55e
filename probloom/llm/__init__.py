"""Operators that prepare training data for language and vision models.

Nothing outside this subpackage imports it.
"""
