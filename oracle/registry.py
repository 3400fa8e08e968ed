"""All DuckDB twins with the adapter text in front."""

import importlib

from oracle.adapter import with_adapter

GROUPS = ["rules", "validation", "graph", "analytics", "features", "usecases", "ml", "streaming"]


def oracle_sql() -> dict[str, str]:
    out = {}
    for group in GROUPS:
        module = importlib.import_module(f"oracle.{group}")
        out.update({name: with_adapter(sql) for name, sql in module.SQL.items()})
    return out
