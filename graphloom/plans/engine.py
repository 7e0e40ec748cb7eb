"""Parse, plan and run query texts."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from graphloom.operators.graph import PropertyGraph
from graphloom.plans import syntax as s
from graphloom.plans.compiler import Planner
from graphloom.plans.parser import parse
from graphloom.plans.syntax import QueryError

WRITES = (s.Create, s.Merge, s.SetClause, s.RemoveClause, s.Delete, s.Foreach)


@dataclass
class Outcome:
    df: DataFrame | None
    graph: PropertyGraph


def _procedures(extra: dict | None) -> dict:
    from graphloom.operators.procedures import PROCEDURES

    return PROCEDURES | {k.lower(): f for k, f in (extra or {}).items()}


def is_write(statement) -> bool:
    return isinstance(statement, s.Single) and any(isinstance(c, WRITES) for c in statement.clauses)


def run(graph: PropertyGraph, text: str, params: dict[str, Any], procedures: dict | None = None, rewrites: bool = True) -> Outcome:
    """Run all statements of `text`; the outcome is that of the last one."""
    clock = dt.datetime.now(dt.timezone.utc)
    out = Outcome(None, graph)
    for statement in parse(text):
        if isinstance(statement, (s.Single, s.Union)) and not is_write(statement):
            planner = Planner(out.graph, params, clock, _procedures(procedures), rewrites)
            out = Outcome(planner.read(statement)[0], out.graph)
        elif isinstance(statement, s.Single):
            from graphloom.operators.writes import write

            out = Outcome(*write(out.graph, statement, params, clock, _procedures(procedures)))
        elif isinstance(statement, s.Ddl):
            from graphloom.operators.writes import define

            out = Outcome(None, define(out.graph, statement))
        elif isinstance(statement, (s.Copy, s.Export, s.Import)):
            from graphloom.sources import bulk

            out = Outcome(*bulk.run(out.graph, statement))
        else:
            raise QueryError(f"{type(statement).__name__} cannot be run")
    return out


def explain(graph: PropertyGraph, text: str, params: dict[str, Any]) -> str:
    """The clauses of the query and the physical plan they lead to."""
    lines = []
    for statement in parse(text):
        for k, clause in enumerate(getattr(statement, "clauses", [statement])):
            lines.append("  " * k + type(clause).__name__)
    df = run(graph, text, params).df
    if df is not None:
        lines.append(df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    return "\n".join(lines)
