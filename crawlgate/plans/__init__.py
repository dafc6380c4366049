"""Whole computations: policies of files, verdicts on URLs."""
