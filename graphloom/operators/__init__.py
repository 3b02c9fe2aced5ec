"""Operators over solution tables and triples."""
