"""Read-only ad hoc SQL over the registered tables.

Spark itself decides, twice, and nothing runs meanwhile. In the parsed plan no
part may be a command, an insert or a script, no name may be computed
(``IDENTIFIER``), and relations must be names, not files. Then the plan is
analysed: what counts are the functions and relations that the names turned out
to mean, however they were spelled. No function may call Java, and every relation
must be a registered view, a table of the catalog, or rows that the statement
makes itself. A word list is one more layer.
"""

from __future__ import annotations

import re

from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# Words that never occur in a read-only statement.
BLOCKED = ("DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE", "TRUNCATE", "EXEC", "EXECUTE")
# The same for statements and functions of Spark SQL that write or run code.
BLOCKED_HERE = ("MERGE", "REFLECT", "TRY_REFLECT", "JAVA_METHOD")

# A raw string ends at the next quote, whatever stands before it; a line comment also ends at a carriage return.
_TEXT = re.compile(
    r"""\br'[^']*'|\br"[^"]*"|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\r\n]*|/\*.*?\*/""",
    re.DOTALL | re.IGNORECASE,
)
# Spark's names for plan parts that are not read-only, or whose meaning is not known when parsed.
_PLANS = "org.apache.spark.sql.catalyst.plans.logical."
_ANALYSIS = "org.apache.spark.sql.catalyst.analysis."
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
_WRITING = tuple(_PLANS + n for n in ("Command", "ParsedStatement", "ScriptTransformation", "CompoundBody"))
_COMPUTED = tuple(_ANALYSIS + n for n in ("PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier"))
_RELATION = _ANALYSIS + "UnresolvedRelation"
_SUBQUERY = _EXPRESSIONS + "PlanExpression"
_EXPRESSION = _EXPRESSIONS + "Expression"
_TREE = "org.apache.spark.sql.catalyst.trees.TreeNode"
# The same for functions that call methods by their names, and for what a statement may read.
_CALLING = tuple(_EXPRESSIONS + n for n in ("CallMethodViaReflection", "TryReflect"))
_VIEW = _PLANS + "View"
_LEAF = _PLANS + "LeafNode"
_OWN_ROWS = tuple(_PLANS + n for n in ("LocalRelation", "OneRowRelation", "Range", "CTERelationRef", "UnionLoopRef"))
_FILES = "org.apache.spark.sql.execution.datasources.LogicalRelation"
_CATALOG = (
    "org.apache.spark.sql.catalyst.catalog.HiveTableRelation",
    "org.apache.spark.sql.execution.datasources.v2.DataSourceV2Relation",
)
_FORBIDDEN = re.compile(rf"\b({'|'.join(BLOCKED + BLOCKED_HERE)})\b", re.IGNORECASE)
_READS = re.compile(r"^[\s(]*(SELECT|WITH|VALUES)\b", re.IGNORECASE)
_SCRIPT = re.compile(r"\bUSING\s*''", re.IGNORECASE)


def _bare(sql: str) -> str:
    """The statement with comments blanked and quoted text emptied."""

    def blank(match: re.Match) -> str:
        return {"-": " ", "/": " ", "`": "``"}.get(match.group()[0], "''")

    return _TEXT.sub(blank, sql)


def check_query(sql: str) -> str | None:
    """Why the statement may not run, or None. Quoted words do not count."""
    bare = _bare(sql).strip()
    if not bare:
        return "Please enter a SQL query"
    found = _FORBIDDEN.search(bare)
    if found:
        return f"Blocked: {found.group(1).upper()} statements not allowed"
    if ";" in bare.rstrip("; \t\r\n"):
        return "Blocked: only one statement allowed"
    if not _READS.match(bare):
        return "Blocked: only SELECT, WITH and VALUES statements allowed"
    if _SCRIPT.search(bare):
        return "Blocked: script transforms not allowed"
    return None


def _items(sequence: JavaObject) -> list[JavaObject]:
    return [sequence.apply(i) for i in range(sequence.size())]


def _walk(spark: SparkSession, plan: JavaObject, closed: str | None = None) -> Iterator[JavaObject]:
    """All plans and expressions of a plan, its subqueries included; nothing below nodes of the class ``closed``."""
    gateway = spark.sparkContext._gateway
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if closed is not None and is_instance_of(gateway, node, closed):
            continue
        if is_instance_of(gateway, node, _SUBQUERY):
            todo.append(node.plan())
        for found in (node.children(), node.innerChildren()):
            todo += [x for x in _items(found) if is_instance_of(gateway, x, _TREE)]
        if not is_instance_of(gateway, node, _EXPRESSION):
            todo += _items(node.expressions())


def check_parsed(spark: SparkSession, plan: JavaObject) -> str | None:
    """Why a parsed plan may not be analysed, or None."""
    gateway = spark.sparkContext._gateway
    for node in _walk(spark, plan):
        if any(is_instance_of(gateway, node, name) for name in _WRITING):
            return "Blocked: only statements that read are allowed"
        if any(is_instance_of(gateway, node, name) for name in _COMPUTED):
            return "Blocked: computed names not allowed"
        if is_instance_of(gateway, node, _RELATION):
            parts = _items(node.multipartIdentifier())
            if len(parts) > 1 and not spark.catalog.databaseExists(parts[0]):
                return "Blocked: only registered tables may be read"
    return None


def check_analysed(spark: SparkSession, plan: JavaObject) -> str | None:
    """Why an analysed plan may not run, or None.

    What a registered view does inside is the business of whoever registered it.
    """
    gateway = spark.sparkContext._gateway
    for node in _walk(spark, plan, _VIEW):
        if any(is_instance_of(gateway, node, name) for name in _WRITING):
            return "Blocked: only statements that read are allowed"
        if any(is_instance_of(gateway, node, name) for name in _CALLING):
            return "Blocked: functions that call Java not allowed"
        if is_instance_of(gateway, node, _LEAF) and not is_instance_of(gateway, node, _VIEW):
            known = any(is_instance_of(gateway, node, name) for name in _OWN_ROWS + _CATALOG)
            if not known and not (is_instance_of(gateway, node, _FILES) and node.catalogTable().isDefined()):
                return "Blocked: only registered tables may be read"
    return None


def check_plan(spark: SparkSession, sql: str) -> str | None:
    """Why the statement may not run, or None. It is parsed and analysed; commands would not be executed."""
    state = spark._jsparkSession.sessionState()
    parsed = state.sqlParser().parsePlan(sql)
    refused = check_parsed(spark, parsed)
    if refused:
        return refused
    skipping = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    execution = state.executePlan(parsed, skipping)
    execution.assertAnalyzed()
    return check_analysed(spark, execution.analyzed())


def run_query(spark: SparkSession, sql: str) -> tuple[DataFrame | None, str | None]:
    """``(frame, None)`` or ``(None, reason)``.

    Parsing and analysis problems come back as text. The frame is lazy, so an
    error in the data itself surfaces when it is read.
    """
    refused = check_query(sql)
    if refused:
        return None, refused
    statement = sql.strip().rstrip("; \t\r\n")
    try:
        refused = check_plan(spark, statement)
        if refused:
            return None, refused
        return spark.sql(statement), None
    except PySparkException as error:
        return None, str(error)
