"""Operators of a training-data pipeline over a corpus of documents.

Nothing else in the library imports this subpackage.  ``queries`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
