"""Operators on text corpora for training language models.  Nothing outside imports this package."""
