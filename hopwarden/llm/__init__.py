"""Algorithms for corpora and very large identifier sets; nothing outside this package imports it."""
