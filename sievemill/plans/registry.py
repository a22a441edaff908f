"""Queries by name with their oracle statements."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, Callable] = {}
        self.statements: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.functions[f.__name__] = f
            if sql is not None:
                self.statements[f.__name__] = sql
            return f

        return add


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_contains_any(c: str, values) -> str:
    return "(" + " or ".join(f"contains({c}, '{str(v).replace(chr(39), chr(39) * 2)}')" for v in values) + ")"


def sql_first_of(c: str, table, default: str) -> str:
    return "case " + " ".join(f"when {sql_contains_any(c, phrases)} then '{label}'" for label, phrases in table) + f" else {default} end"
