"""Registered queries: how the operators are composed over the given tables."""
