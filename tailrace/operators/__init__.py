"""Relational operators of the revenue model."""
