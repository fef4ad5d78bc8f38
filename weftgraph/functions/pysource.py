"""Arrow-batch helper that reads Python imports with the standard ``ast`` module."""

from __future__ import annotations

import ast

import pandas as pd


def parse_source(source: str | None) -> tuple[str | None, list[dict]]:
    """(error, import records) of one file; breadth-first order over the tree."""
    if source is None:
        return "read failed", []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as exc:
        return f"parse failed: {type(exc).__name__}: {exc}", []
    found = []
    for stmt in ast.walk(tree):
        if isinstance(stmt, ast.Import):
            targets = [(a.name, 0, [a.name]) for a in stmt.names]
        elif isinstance(stmt, ast.ImportFrom) and stmt.module is None:
            targets = [(a.name, stmt.level, ["*"]) for a in stmt.names]
        elif isinstance(stmt, ast.ImportFrom):
            targets = [(stmt.module, stmt.level, [a.name for a in stmt.names])]
        else:
            continue
        found += [
            {"specifier": m, "level": n, "type": "import", "symbols": s} for m, n, s in targets
        ]
    return None, found


def parse_batch(content: pd.Series) -> pd.DataFrame:
    rows = [parse_source(text) for text in content]
    return pd.DataFrame({"error": [r[0] for r in rows], "imports": [r[1] for r in rows]})
