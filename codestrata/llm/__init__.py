"""Operators for large training-data pipelines, and the queries that apply them.

Nothing outside this folder (and ``corpus_pipeline.py`` beside it) imports it.
"""
