"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from skein.operators import align, api, counters, crawl, evaluate, profiles, references, retrieve, topics, trend
from skein.plans import roundtrips

_MODULES = (references, counters, trend, profiles, topics, align, retrieve, evaluate, api, crawl, roundtrips)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
