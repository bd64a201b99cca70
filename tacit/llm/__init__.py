"""Operators of a training-data pipeline over documents, pages, vectors and conversations.

Nothing outside this package imports it.  ``queries`` registers one query per operator.
"""
