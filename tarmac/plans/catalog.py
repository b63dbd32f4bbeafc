"""The register of queries: each operator's name, its Spark query over the given tables, and DuckDB text for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.sources.fixtures import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_fixtures(sql: str) -> str:
    """sql behind common table expressions for the fixtures that it names, in the order of SQL."""
    found, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in re.findall(r"(?i)(?:from|join|,)\s+(\w+)", text):
            if name in SQL and name not in found:
                found.add(name)
                todo.append(SQL[name])
    if not found:
        return sql
    heads = ",\n".join(f"{n} AS ({SQL[n]})" for n in SQL if n in found)
    body = sql.strip()
    if m := re.match(r"(?i)with\s+(recursive\s+)?", body):
        return f"WITH {m[1] or ''}{heads},\n{body[m.end():]}"
    return f"WITH {heads}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql is its DuckDB text, absent where SQL can't express it."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_fixtures(sql)
        return f

    return put


#: A value on the border between two roundings may fall either way by its last bit; this shift moves it off the border.
SHIFT = 1.3e-8
#: DuckDB text of r6.
R = "round({} + 1.3e-8::DOUBLE, 6) + 0.0::DOUBLE"


def r6(c):
    """Rounded to six decimals, the same in every engine, without a negative zero."""
    return F.round(c + SHIFT, 6) + F.lit(0.0)
