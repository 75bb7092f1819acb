"""Corpus, retrieval and evaluation analytics as DataFrame functions."""
