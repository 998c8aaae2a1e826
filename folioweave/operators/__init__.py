"""Relational operators over captures, pairs, groups and reviews."""
