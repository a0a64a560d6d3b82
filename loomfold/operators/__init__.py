"""Relational operators: scoring, ranking, pruning, outfits, metrics."""
