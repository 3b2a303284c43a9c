"""Operators for language-model training data: near-duplicates, clusters, packing, leakage, sentences."""
