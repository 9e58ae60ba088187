"""Registered queries over the given tables, and the user-level jobs they compose into."""
