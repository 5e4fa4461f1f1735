"""Operators for preparing training text: filters, deduplication, search, language models, tokenisation, mixing.

Nothing else in the library imports this subpackage.
"""
