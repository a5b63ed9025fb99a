"""Registered queries: each applies operators to the on-chain lenses of the given tables."""
