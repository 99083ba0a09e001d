"""Operators and the pipeline for preparing training text of language models.

Nothing else in the library imports this subpackage.
"""
