"""Operators for training data: texts, code chunks and symbols. Nothing outside this subpackage imports it."""
