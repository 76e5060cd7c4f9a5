"""Operators of a training-data pipeline over corpora of documents, vectors and web pages.

Nothing else in the package imports this subpackage.
"""
