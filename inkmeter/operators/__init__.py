"""Relational operators: pairings, overlap, records."""
