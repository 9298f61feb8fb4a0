"""The queries of the llm problems and their SQL."""

from __future__ import annotations

from skein.llm import conversations, density, encoding, gram, leaks, neighbours, poisson, spans, trie

_MODULES = (gram, density, neighbours, trie, poisson, conversations, encoding, leaks, spans)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
