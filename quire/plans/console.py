"""Read-only SQL over registered tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Words refused anywhere in a statement, and the words a statement may start with.
MUTATING = re.compile(
    r"\b(DROP|DELETE|INSERT|UPDATE|ALTER|ATTACH|CREATE|REPLACE|COPY|TRUNCATE|GRANT|REVOKE)\b", re.IGNORECASE
)
# What runs a program or calls into the JVM from inside a reading statement.
CALLING = re.compile(r"\bUSING\s*['\"]|\b(REFLECT|JAVA_METHOD|TRY_REFLECT)\b", re.IGNORECASE)
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.DOTALL)
READING = ("SELECT", "WITH", "VALUES", "DESCRIBE", "SHOW", "EXPLAIN", "TABLE")
_LEADING = re.compile(r"(?:\s|\(|--[^\n]*(?:\n|\Z)|/\*.*?\*/)*(\w*)", re.DOTALL)


def guard(query: str) -> str:
    """The stripped statement, or PermissionError when it could change anything or run anything but SQL: a script
    transform names its program in a string after USING, wherever it stands, and reflective functions have names."""
    text = query.strip()
    first = _LEADING.match(text).group(1).upper()
    bare = _COMMENT.sub(" ", text)
    if MUTATING.search(text) or CALLING.search(text) or CALLING.search(bare) or (text and first not in READING):
        raise PermissionError("this console only reads: the statement could change data or run a program")
    return text


_RELATION = re.compile(r"Unresolved(?:Relation|TableOrView|Table|View|Identifier) \[([^\n]*?)\](?:,|\n|\Z|$)")
_NAMED = re.compile(r"CTE \[([^\]\n]*)\]")


def relations(spark: SparkSession, text: str) -> set[str]:
    """Names of what a statement reads, in subqueries too, by its parsed plan; its own common table expressions apart.

    A file read by its path shows as a name of two parts, the format and the path.
    """
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if parsed.getClass().getSimpleName() == "ExplainCommand":
        parsed = parsed.logicalPlan()
    plan = parsed.toString()
    own = {n.strip().lower() for found in _NAMED.findall(plan) for n in found.split(",")}
    return {n for n in _RELATION.findall(plan) if n.lower() not in own}


def check_relations(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None) -> None:
    """PermissionError for a statement that reads anything but the given tables; without any, but known tables."""
    given = {name.lower() for name in tables or {}}
    for name in relations(spark, text):
        known = name.lower() in given if given else spark.catalog.tableExists(".".join(f"`{p}`" for p in name.split(", ")))
        if not known:
            raise PermissionError(f"this console reads the given tables only, not {name}")


def read_only_sql(
    spark: SparkSession,
    query: str,
    params: Sequence[Any] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Run one reading statement with positional parameters over temp views of ``tables``; blank gives no rows.

    The parsed plan must name no other relation, so files cannot be read by their path.
    """
    text = guard(query).rstrip(";")
    if not text:
        return spark.createDataFrame([], "empty string")
    check_relations(spark, text, tables)
    held = {
        name: spark.table(name) if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary else None
        for name in tables or {}
    }
    try:
        for name, table in (tables or {}).items():
            table.createOrReplaceTempView(name)
        return spark.sql(text, args=list(params)) if params else spark.sql(text)
    finally:  # the result is analyzed; the caller's views are put back
        for name, table in held.items():
            spark.catalog.dropTempView(name)
            if table is not None:
                table.createOrReplaceTempView(name)
