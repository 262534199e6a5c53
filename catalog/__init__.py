
from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}

for _group in ("sources", "corpus", "graph_build", "graph", "retrieval", "context", "agent", "evaluation", "streams", "functions"):
    _module = importlib.import_module(f"catalog.{_group}")
    for _name, _fn in _module.QUERIES.items():
        if _name in QUERIES:
            raise ValueError(f"{_name} is registered twice")
        QUERIES[_name] = _fn
    SQL.update(_module.SQL)
