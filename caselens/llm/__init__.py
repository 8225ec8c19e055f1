"""Operators and queries of the training-data pipeline; nothing else of the library imports this folder."""
