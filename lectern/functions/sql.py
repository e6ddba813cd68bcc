"""The text and course functions for SQL users: the same expressions as the ``Column`` builders."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lectern.functions import courses, text


INFIX = {"and": "AND", "or": "OR", **{c: c for c in ("=", "<=>", "<", ">", "<=", ">=", "+", "-", "*", "/", "%")}}


def spelled(column: Column) -> str:
    """The SQL text of an expression over plain names, lambdas, fields and cases."""
    return _spelled(column._jc.node())


def _each(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _name(text: str) -> str:
    return "`" + text.replace("`", "``") + "`"


def _spelled(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        return _call(node.functionName(), [_spelled(a) for a in _each(node.arguments())])
    if kind == "UnresolvedAttribute":
        return ".".join(_name(part) for part in _each(node.nameParts()))
    if kind == "UnresolvedNamedLambdaVariable":
        return node.name()
    if kind == "LambdaFunction":
        given = [_spelled(a) for a in _each(node.arguments())]
        return f"{given[0] if len(given) == 1 else '(' + ', '.join(given) + ')'} -> {_spelled(node.function())}"
    if kind == "CaseWhenOtherwise":
        cases = [f"WHEN {_spelled(b._1())} THEN {_spelled(b._2())}" for b in _each(node.branches())]
        rest = f" ELSE {_spelled(node.otherwise().get())}" if node.otherwise().isDefined() else ""
        return f"CASE {' '.join(cases)}{rest} END"
    if kind == "UnresolvedExtractValue":
        return f"{_spelled(node.child())}[{_spelled(node.extraction())}]"
    if kind == "Cast":
        return f"CAST({_spelled(node.child())} AS {node.dataType().sql()})"
    if kind == "Alias":
        (name,) = _each(node.name())
        return f"{_spelled(node.child())} AS {_name(name)}"
    if kind == "Literal":
        # A bare 0.3 would be a decimal.
        return f"{node.value()!r}D" if isinstance(node.value(), float) else node.sql()
    raise ValueError(f"no SQL for {kind}")


def _call(name: str, args: list[str]) -> str:
    if name in INFIX and len(args) == 2:
        return f"({args[0]} {INFIX[name]} {args[1]})"
    if name in ("!", "not"):
        return f"(NOT {args[0]})"
    if name == "negative":
        return f"(- {args[0]})"
    if name == "in":
        return f"({args[0]} IN ({', '.join(args[1:])}))"
    return f"{name}({', '.join(args)})"


def _scalars() -> dict[str, tuple[str, str, Column]]:
    """Name: parameters, result, body."""
    c = F.col
    return {
        "course_content_words": ("input STRING", "ARRAY<STRING>", text.content_words(c("input"))),
        "content_coverage": (
            "query_words ARRAY<STRING>, title_words ARRAY<STRING>",
            "DOUBLE",
            text.coverage(c("query_words"), c("title_words")),
        ),
        "course_level": ("course_number STRING", "STRING", courses.course_level(c("course_number"))),
        "course_number_key": ("course_number STRING", "STRING", text.squash(c("course_number"))),
        "similarity": ("a STRING, b STRING", "DOUBLE", text.similarity(c("a"), c("b"))),
        "word_similarity": ("query STRING, title STRING", "DOUBLE", text.word_similarity(c("query"), c("title"))),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; Catalyst inlines them into the queries that call them."""
    made = _scalars()
    for name, (given, result, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {spelled(body)}")
    return list(made)
