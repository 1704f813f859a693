"""Operators that prepare training data; an optional part that nothing else in the library imports."""
