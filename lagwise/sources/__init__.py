"""Readers and writers of series, labels and results."""
