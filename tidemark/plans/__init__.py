"""Composite queries built from the operators: market outcomes, canonical tables, data contracts."""
