"""Graph patterns over arriving triples."""
