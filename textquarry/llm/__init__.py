"""Operators for training-data pipelines over document tables.

Every module holds one operator with a general interface; ``queries`` derives the
registered results from them.  Nothing outside this package imports it.
"""
