"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it; deleting it leaves the rest of
the library working.
"""
