"""Operators for large training-text pipelines; nothing outside this subpackage imports it."""
