"""Operators for training data from listing texts; nothing outside this subpackage imports it."""
