"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lakeloom.llm import cooccurrence, packing, sentences, terms, tokens

_ALL = (terms, cooccurrence, tokens, packing, sentences)
QUERIES = {name: q for m in _ALL for name, q in m.QUERIES.items()}
SQL = {name: q for m in _ALL for name, q in m.SQL.items()}
