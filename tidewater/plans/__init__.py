"""Parsing, binding and explaining statements."""
