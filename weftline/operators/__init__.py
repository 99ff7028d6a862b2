"""Relational operators over a coded corpus."""
