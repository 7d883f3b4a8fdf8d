"""A guarded entry for ad-hoc SELECT statements.

Two gates stand before a query runs. The parsed text may hold only names that are written
out: tables that are views or its own common table expressions, functions of Spark's own
registry in the groups below. What Spark makes of it is then walked once more: every leaf
of the analysed plan must lie below a registered view or be made of the query's own
values, and every expression must be one of Spark's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

ROW_CAP = 1000
#: Groups of Spark's functions that compute on values alone. Others read files, run code or tell about the session.
GROUPS = frozenset(
    f"{g}_funcs"
    for g in (
        "agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate "
        "sketch string struct url variant window"
    ).split()
)
#: Of the other groups these are free too.
MORE = frozenset({"typeof", "equal_null", "monotonically_increasing_id"})
#: Nodes of a parsed query whose name is the value of an expression, or that run a program.
UNNAMED = frozenset({
    "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier", "UnresolvedIdentifier", "ScriptTransformation",
    "NameParameterizedQuery", "PosParameterizedQuery",
})
#: Leaves of an analysed plan that read nothing.
OWN_VALUES = frozenset({"OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"})
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
#: Spark's expressions that call code by name.
CALLS = frozenset({"CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDF", "ScalaAggregator", "Invoke", "StaticInvoke", "NewInstance"})


@dataclass(frozen=True)
class Answer:
    """The first rows and the full count, or a message."""

    rows: DataFrame | None = None
    total: int = 0
    error: str | None = None


def safe_select(
    spark: SparkSession, sql: str, views: Mapping[str, Callable[[SparkSession], DataFrame]], cap: int = ROW_CAP
) -> Answer:
    """Run one SELECT (or WITH) over the named views only.

    The text becomes a subquery, where Spark's grammar admits queries but no
    command, in a fresh session that sees the views and no path. Words in literals,
    comments and column names are free.
    """
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(select|with)\b", text, re.IGNORECASE):
        return Answer(error="Only SELECT queries are allowed")
    guard = spark.newSession()
    guard.conf.set("spark.sql.runSQLOnFiles", "false")
    wrapped = f"SELECT * FROM (\n{text}\n) AS answer"
    try:
        refused = _refused_text(guard, wrapped, set(views))
        if refused:
            return Answer(error=refused)
        for name, build in views.items():
            build(guard).createOrReplaceTempView(name)
        found = guard.sql(wrapped)
        refused = _refused_plan(found._jdf.queryExecution().analyzed(), {v.lower() for v in views})
        if refused:
            return Answer(error=refused)
        return Answer(rows=found.limit(cap), total=found.count())
    except PySparkException as failure:
        return Answer(error=str(failure).strip().splitlines()[0])


def _allowed_function(guard: SparkSession, name: str) -> bool:
    if name in MORE:
        return True
    jvm = guard._jvm
    named = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    info = guard._jsparkSession.sessionState().functionRegistry().lookupFunction(named)
    return info.isDefined() and info.get().getGroup() in GROUPS


def _refused_text(guard: SparkSession, text: str, views: set[str]) -> str | None:
    """Why the parsed query may not be analysed, or None."""
    plan = json.loads(guard._jsparkSession.sessionState().sqlParser().parsePlan(text).toJSON())
    nodes, own = [], set()
    open_values = [plan]
    while open_values:
        value = open_values.pop()
        if isinstance(value, dict):
            nodes.append(value)
            # A common table expression may be read by its name.
            own |= {c["_1"].lower() for c in value.get("cteRelations", [])}
            open_values += value.values()
        elif isinstance(value, list):
            open_values += value
    # A name in use by a stored table must not be opened by an expression of that name.
    named = {v.lower() for v in views} | {n for n in own if not guard.catalog.tableExists(n)}
    for node in nodes:
        kind = node.get("class", "").rpartition(".")[2]
        if kind in UNNAMED:
            return "The query computes a name or runs a program, which is not allowed"
        if kind == "UnresolvedTableValuedFunction":
            return "Table functions are not allowed"
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = _parts(node["nameParts"]) if "nameParts" in node else [_generator(node["name"])]
            if len(parts) > 1 or not _allowed_function(guard, parts[0]):
                return f"The function {'.'.join(parts)} is not allowed"
        if kind == "UnresolvedRelation":
            parts = _parts(node["multipartIdentifier"])
            if len(parts) > 1 or parts[0] not in named:
                return f"The table {'.'.join(parts)} is not allowed"
    return None


def _parts(listed: str) -> list[str]:
    return listed.strip("[]").lower().split(", ")


def _generator(name: object) -> str:
    """The name of a generator: an identifier with its database, or its text."""
    return str(name.get("funcName") if isinstance(name, dict) else name).lower()


def _items(sequence: JavaObject) -> Iterator[JavaObject]:
    return (sequence.apply(i) for i in range(sequence.size()))


def _refused_plan(plan: JavaObject, views: set[str]) -> str | None:
    """Why the analysed plan may not run, or None. What a registered view holds is not looked at."""
    open_plans, open_expressions = [plan], []
    while open_plans or open_expressions:
        if open_plans:
            node = open_plans.pop()
            kind = node.nodeName()
            if kind == "View":
                known = node.isTempView() and node.desc().identifier().database().isEmpty()
                name = node.desc().identifier().table().lower()
                if not known or name not in views:
                    return f"The table {name} is not allowed"
                continue
            children = list(_items(node.children()))
            if not children and kind not in OWN_VALUES:
                return f"The query reads {kind}, which is no registered view"
            open_plans += children
            open_expressions += _items(node.expressions())
        else:
            value = open_expressions.pop()
            full = value.getClass().getName()
            if not full.startswith(EXPRESSIONS) or full.rpartition(".")[2] in CALLS:
                return f"The query uses {full.rpartition('.')[2]}, which is not allowed"
            open_expressions += _items(value.children())
            if value.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
                open_plans.append(value.plan())
    return None
