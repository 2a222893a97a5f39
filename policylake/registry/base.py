"""Registry of runnable queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from policylake.functions.text import SPACE_CHARS
from policylake.sources.policy_docs import POLICY_DOCS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "1998-01-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""
    def register(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"{fn.__name__} is registered twice")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


# --- building blocks for the checking SQL --------------------------------------------

def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def with_docs(body: str, *ctes: str) -> str:
    """The derived policy documents, further steps, and a statement over them."""
    return "with " + ",\n".join([f"policy_docs as ({POLICY_DOCS_SQL})", *ctes]) + "\n" + body


def any_contains(text: str, terms: Iterable[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def sum_contains(text: str, terms: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {q(t)})::int" for t in terms) + ")"


def count_in(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {q(term)}, ''))) // {len(term)})"


def sum_counts(text: str, weights: dict[str, int]) -> str:
    return "(" + " + ".join(f"{w} * {count_in(text, t)}" for t, w in weights.items()) + ")"


def first_case(cases: Iterable[tuple[str, str]], default: str = "null") -> str:
    return "case " + " ".join(f"when {c} then {q(n)}" for c, n in cases) + f" else {default} end"


def argmax_case(scores: list[tuple[str, str]], default: str) -> str:
    """First name with the greatest positive score."""
    best = f"greatest({', '.join(s for _, s in scores)})"
    return (f"case when {best} <= 0 then {default} "
            + " ".join(f"when {s} = {best} then {q(n)}" for n, s in scores) + " end")


def py_strip(text: str) -> str:
    return f"trim({text}, {q(SPACE_CHARS)})"


SQL_WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
