"""Relational operators: curation, ranking, classification, latents, resampling."""
