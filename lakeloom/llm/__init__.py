"""Operators for text corpora: term statistics, co-occurrence, tokens, packing, sentences.

Nothing outside this subpackage imports it.
"""
