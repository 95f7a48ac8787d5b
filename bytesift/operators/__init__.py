"""Operators of the engine: exact and index predicates, searches, de-duplication, maintenance."""
