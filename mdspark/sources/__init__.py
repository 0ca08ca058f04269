"""Readers of simulation text files and writers of results."""
