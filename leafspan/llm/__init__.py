"""Operators for large-scale preparation of training data; nothing outside this subpackage imports it."""
