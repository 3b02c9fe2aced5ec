"""Operators for preparing training text at scale.

Nothing else in the package imports this folder.  Each operator module has a
general interface; ``queries`` holds the thin registered queries.
"""
