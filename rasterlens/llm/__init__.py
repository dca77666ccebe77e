"""Corpus operators for training data; see ``queries`` for their queries and SQL."""
