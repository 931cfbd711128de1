"""How a query and the SQL it must agree with are registered together.

A spec names the result's columns in order. `~` rounds to 6 places, `$` to 2,
`#` makes a long, on both sides; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures

Query = Callable[["fixtures.Tables"], DataFrame]


def _parts(spec: str) -> list[tuple[str, str]]:
    return [(m[1], m[2]) for m in re.finditer(r"(\w+)([~$#]?)", spec)]


def shape(df: DataFrame, spec: str) -> DataFrame:
    how = {"~": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0), "$": lambda c: F.round(F.col(c).cast("double"), 2) + F.lit(0.0), "#": lambda c: F.col(c).cast("long"), "": F.col}
    return df.select(*[how[mark](name).alias(name) for name, mark in _parts(spec)])


def shape_sql(sql: str, spec: str) -> str:
    how = {"~": "round(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}", "$": "round(CAST({0} AS DOUBLE), 2) + 0.0 AS {0}", "#": "CAST({0} AS BIGINT) AS {0}", "": "{0}"}
    columns = ", ".join(how[mark].format(f'"{name}"') for name, mark in _parts(spec))
    sql = sql.strip().rstrip(";")
    views, names = [], [n for n in fixtures.SQL if re.search(rf"\b{n}\b", sql)]
    # Views may be made of other views: take those too, in the order they are defined in.
    while True:
        more = [n for n in fixtures.SQL if n not in names and any(re.search(rf"\b{n}\b", fixtures.SQL[x]) for x in names)]
        if not more:
            break
        names += more
    views = [f"{n} AS ({fixtures.SQL[n].strip()})" for n in fixtures.SQL if n in names]
    recursive = ""
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.I):
        recursive, rest = m[1] or "", sql[m.end() :]
        cut = _main_select(rest)
        views.append(rest[:cut].strip())
        sql = rest[cut:]
    head = f"WITH {recursive}{', '.join(views)} " if views else ""
    return f"{head}SELECT {columns} FROM ({sql}) AS result"


def _main_select(sql: str) -> int:
    """Where the main SELECT stands after a list of common table expressions."""
    depth = 0
    for m in re.finditer(r"[()]|'[^']*'|\bSELECT\b", sql, re.I):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
        elif m[0].upper() == "SELECT" and not depth:
            return m.start()
    raise ValueError("no main SELECT")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, spec: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = lambda spark, sf_dir: shape(query(fixtures.Tables(spark, sf_dir)), spec)
        if sql is not None:
            self.oracle[name] = shape_sql(sql, spec)
