"""Operators of training-data pipelines over documents, pages and embeddings.

Each module is one operator with a general interface; ``queries`` applies them to the test tables.
Nothing outside this package imports it.
"""
