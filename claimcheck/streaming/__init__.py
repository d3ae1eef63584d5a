"""Verdicts on a stream of texts."""
