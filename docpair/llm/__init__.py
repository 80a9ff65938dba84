"""Operators that prepare training data; nothing outside this subpackage imports it."""
