"""Operators of a training-data pipeline: packing, searches, language, mixing, shards, pages, urls, copies, licenses.

Nothing else in the library imports this folder.
"""
