"""Readers, writers and the typed schemas of canonical tables."""
