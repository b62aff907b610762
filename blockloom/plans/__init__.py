"""Whole queries built from the operators, and their SQL equivalents."""
