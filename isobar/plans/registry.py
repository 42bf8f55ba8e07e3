"""Named queries: what each runs, which operators it covers, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from isobar.session import prepare

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    covers: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}

TIE_SHIFT = 3


def off_ties(sql: str) -> str:
    """Add 3 units, three digits down, before each ``round(x, d) + 0.0``.

    Means of money land exactly on a rounding tie, where the last bit of a sum
    decides. Both engines move off the tie by the same amount (see ``tables.rd``).
    """
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + len("round(") : end - 1]
        body, _, digits = inner.rpartition(",")
        if sql[end:].startswith(" + 0.0") and digits.strip().isdigit():
            shift = f"{TIE_SHIFT}e-{int(digits) + 3}"
            out += sql[at:start] + f"round({off_ties(body)} + {shift},{digits})"
        else:
            out += sql[at:start] + f"round({off_ties(inner)})"
        at = end
    return out + sql[at:]


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function of (spark, sf_dir) under ``name``."""

    def add(fn: Run) -> Run:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, run, tuple(covers.split()), off_ties(sql) if sql else None)
        return fn

    return add
