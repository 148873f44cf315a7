"""Operators on text collections; nothing outside this subpackage imports it."""
