"""Oracle SQL assembly: named CTE fragments with dependencies.

Oracle queries are independent ANSI-SQL restatements of each operator,
run by DuckDB over the raw parquet views. Fragments are registered by name;
``with_ctes(body, deps)`` prepends the needed fragments in dependency order.
"""

from __future__ import annotations

from ..sources.fixtures import ORACLE_INPUT_CTES

_FRAGMENTS: dict[str, tuple[str, tuple[str, ...]]] = {
    name: (sql, ()) for name, sql in ORACLE_INPUT_CTES.items()
}


def fragment(name: str, sql: str, deps: tuple[str, ...] | list[str] = ()) -> str:
    _FRAGMENTS[name] = (sql, tuple(deps))
    return name


def _order(deps) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in _FRAGMENTS[n][1]:
            visit(d)
        seen.append(n)

    for d in deps:
        visit(d)
    return seen


def with_ctes(body: str, deps) -> str:
    names = _order(deps)
    if not names:
        return body
    parts = [f"{n} AS (\n{_FRAGMENTS[n][0].strip()}\n)" for n in names]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def R(expr: str, scale: int) -> str:
    """Round a double HALF_UP on its shortest decimal text (same digits as ``exprs.dround``).

    Spark turns a double into a decimal through its shortest decimal string;
    DuckDB's direct cast scales in binary and is inexact for large values, so
    the oracle goes through VARCHAR explicitly.
    """
    return f"CAST(ROUND(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,10)), {scale}) AS DOUBLE)"


def D(v: float) -> str:
    """A DOUBLE literal (exponent form types as DOUBLE in both engines)."""
    s = repr(float(v))
    return s if "e" in s else s + "e0"
