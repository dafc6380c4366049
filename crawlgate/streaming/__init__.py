"""Verdicts on a stream of URLs."""
