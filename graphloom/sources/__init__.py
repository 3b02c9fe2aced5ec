"""Where triples come from and where results go."""
