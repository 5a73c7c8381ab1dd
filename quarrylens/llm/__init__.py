"""Operators that prepare training data from source code and texts about it.

Nothing outside this subpackage imports it.
"""
