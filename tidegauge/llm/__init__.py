"""Operators for preparing text corpora at scale. Nothing outside this subpackage imports it."""
