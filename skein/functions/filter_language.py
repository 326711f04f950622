"""Predicates over nodes and relationships, parsed into Spark columns.

    n:Person AND n.age >= 18 AND NOT (n.name = 'x' OR n.score <> $limit)

Labels of a node are all needed, types of a relationship any. Logic is two-valued: what is
null or not a number compares false. Doubles are compared within EPSILON."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-7
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.\d*(?:[eE][-+]?\d+)?|\.\d+|\d+(?:[eE][-+]?\d+)?)|(?P<string>'[^']*'|\"[^\"]*\")|(?P<param>\$\w+)|(?P<quoted>`[^`]+`)|(?P<name>[A-Za-z_]\w*)|(?P<mark><>|<=|>=|[=<>():.\-|]))")
_LONGS = ("tinyint", "smallint", "int", "bigint")


@dataclass
class _Value:
    column: Column
    kind: str  # long, double, string or boolean


@dataclass
class Predicate:
    column: Column
    degrees: list[tuple[str, str | None]]

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self.column)

    def apply_to_nodes(self, nodes: DataFrame, rels: DataFrame) -> DataFrame:
        """Degrees that the predicate uses are joined in first."""
        out = nodes
        for name, type_ in self.degrees:
            mine = rels if type_ is None else rels.filter(F.col("relationshipType") == type_)
            count = mine.groupBy(F.col("sourceNodeId").alias("nodeId")).agg(F.count("*").alias(name))
            out = out.join(count, "nodeId", "left").fillna(0, [name])
        return out.filter(self.column).select(*nodes.columns)


class _Parser:
    def __init__(self, text: str, variable: str, types: dict, parameters: dict):
        self.text, self.variable, self.types, self.parameters = text, variable, types, parameters
        self.tokens, self.at, self.degrees = self._split(text), 0, []

    def _split(self, text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at:]!r} in {text!r}")
            out.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        return [*out, ("end", "")]

    def word(self) -> str:
        kind, value = self.tokens[self.at]
        return value.upper() if kind == "name" else value

    def take(self, *expected: str) -> str:
        value = self.word()
        if expected and value not in expected:
            raise ValueError(f"expected {' or '.join(expected)} at {self.tokens[self.at][1]!r} in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def _chain(self, words: tuple[str, ...], below: Callable[[], _Value], join: Callable[[Column, Column], Column]) -> _Value:
        left = below()
        while self.word() in words:
            self.take()
            left = _Value(join(_truth(left), _truth(below())), "boolean")
        return left

    def disjunction(self) -> _Value:
        return self._chain(("OR",), self.exclusive, lambda a, b: a | b)

    def exclusive(self) -> _Value:
        return self._chain(("XOR",), self.conjunction, lambda a, b: a != b)

    def conjunction(self) -> _Value:
        return self._chain(("AND",), self.negation, lambda a, b: a & b)

    def negation(self) -> _Value:
        if self.word() == "NOT":
            self.take()
            return _Value(~_truth(self.negation()), "boolean")
        left = self.atom()
        if self.word() in ("=", "<>", "<", "<=", ">", ">="):
            return _compared(self.take(), left, self.atom())
        return left

    def atom(self) -> _Value:
        kind, raw = self.tokens[self.at]
        if raw == "(":
            self.take()
            inside = self.disjunction()
            self.take(")")
            return inside
        if raw == "-":
            self.take()
            inside = self.atom()
            return _Value(-inside.column, inside.kind)
        self.at += 1
        if kind == "number":
            return _Value(F.lit(int(raw)), "long") if raw.isdigit() else _Value(F.lit(float(raw)), "double")
        if kind == "string":
            return _Value(F.lit(raw[1:-1]), "string")
        if kind == "param":
            if raw[1:] not in self.parameters:
                raise ValueError(f"parameter {raw} is missing")
            return _literal(self.parameters[raw[1:]])
        if kind == "name" and raw.upper() in ("TRUE", "FALSE"):
            return _Value(F.lit(raw.upper() == "TRUE"), "boolean")
        if kind == "name" and raw.lower() == "degree" and self.word() == "(":
            self.take("(")
            type_ = None if self.word() == ")" else self.take().strip("'\"`")
            self.take(")")
            name = f"__degree_{len(self.degrees)}"
            self.degrees.append((name, type_))
            return _Value(F.col(name), "long")
        if kind == "name" and raw == self.variable:
            mark = self.take(".", ":")
            if mark == ".":
                name = self.take().strip("`")
                if name not in self.types:
                    raise ValueError(f"property {name!r} is not there; there are {sorted(self.types)}")
                t = self.types[name]
                return _Value(F.col(f"`{name}`"), "long" if t in _LONGS else "double" if t in ("double", "float") else t)
            names = [self.take().strip("`")]
            while self.word() in (":", "|"):
                self.take()
                names.append(self.take().strip("`"))
            if "labels" in self.types:
                found = F.lit(True)
                for n in names:
                    found = found & F.array_contains("labels", n)
            else:
                found = F.col("relationshipType").isin(*names)
            return _Value(found, "boolean")
        raise ValueError(f"unexpected {raw or 'end'!r} in {self.text!r}; the variable here is {self.variable}")


def _literal(x) -> _Value:
    kind = "boolean" if isinstance(x, bool) else "long" if isinstance(x, int) else "double" if isinstance(x, float) else "string"
    return _Value(F.lit(x), kind)


def _truth(v: _Value) -> Column:
    return F.coalesce(v.column if v.kind == "boolean" else v.column != 0, F.lit(False))


def _compared(sign: str, a: _Value, b: _Value) -> _Value:
    x, y = a.column, b.column
    if {a.kind, b.kind} <= {"long", "double"} and "double" in (a.kind, b.kind):
        x, y = x.cast("double"), y.cast("double")
        near = F.abs(x - y) < EPSILON
        out = {"=": near, "<>": ~near, "<": (x < y) & ~near, "<=": (x < y) | near, ">": (x > y) & ~near, ">=": (x > y) | near}[sign]
        out = out & ~F.isnan(x) & ~F.isnan(y) if sign != "<>" else out | F.isnan(x) | F.isnan(y)
    else:
        out = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]
    return _Value(F.coalesce(out, F.lit(False)), "boolean")


def parse_filter(text: str, variable: str, types: dict, parameters: dict | None = None) -> Predicate:
    """types: column names and Spark types of what the predicate is over."""
    parser = _Parser(text, variable, types, parameters or {})
    value = parser.disjunction()
    parser.take("")
    return Predicate(_truth(value), parser.degrees)
