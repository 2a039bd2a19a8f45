"""Verbs on arrays and collections."""
