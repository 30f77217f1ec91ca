"""Operators for training data: names, digests, tokens, containers and pieces."""
