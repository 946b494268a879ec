"""Operators that prepare training text, each over whole tables and whole texts."""
