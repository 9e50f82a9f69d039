"""The filter language: JSON arrays `[operator, argument, ...]`, compiled to boolean Columns."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilesieve.functions import values as V
from tilesieve.plans import regex


class ExpressionError(ValueError):
    """An expression that can't be compiled."""


@dataclass(frozen=True)
class Node:
    """A checked expression: an operator, its sub-expressions, and what it was given besides these."""

    op: str
    args: tuple["Node", ...] = ()
    given: Any = None


#: Operators by how their arguments are read.
COMPARISONS = ("==", "!=", "<", ">", "<=", ">=")
LOGIC = ("any", "all", "none")
CONTEXT = ("key", "type")
EXTENSIONS = ("not-in", "string")


def _count(args: list[Any], n: int, least: bool = False) -> None:
    if (len(args) < n) if least else (len(args) != n):
        raise ExpressionError(f"Expected {'at least ' if least else ''}{n} arguments, got {len(args)}")


def _string(x: Any, what: str) -> str:
    if not isinstance(x, str):
        raise ExpressionError(f"{what} must be a string")
    return x


def parse(doc: Any, extensions: bool = False) -> Node:
    """Checks an expression, sub-expressions first. Scalars stand for themselves.

    extensions: also accept `not-in` and `string`, which the documentation of the language names.
    """
    if isinstance(doc, dict):
        raise ExpressionError("an object is not an expression")
    if not isinstance(doc, list):
        return Node("literal", given=_finite(doc))
    if not doc:
        raise ExpressionError("an expression must not be empty")
    op, args = doc[0], doc[1:]
    if not isinstance(op, str):
        raise ExpressionError("an expression must begin with an operator")
    sub = functools.partial(parse, extensions=extensions)
    if op in COMPARISONS:
        _count(args, 2)
        return Node(op, (sub(args[0]), sub(args[1])))
    if op in LOGIC:
        return Node(op, tuple(map(sub, args)))
    if op in ("not", "!", "boolean") or extensions and op == "string":
        _count(args, 1)
        return Node("not" if op == "!" else op, (sub(args[0]),))
    if op == "in" or extensions and op == "not-in":
        _count(args, 2)
        first, items = sub(args[0]), sub(args[1])
        if items.op != "literal" or not isinstance(items.given, list):
            raise ExpressionError(f"the second argument of {op!r} must be a literal array")
        found = Node("in", (first,), items.given)
        return found if op == "in" else Node("not", (found,))
    if op in ("starts-with", "ends-with"):
        _count(args, 2)
        return Node(op, (sub(args[0]),), _string(args[1], f"the second argument of {op!r}"))
    if op == "regex-match":
        _count(args, 2)
        return Node(op, (sub(args[0]),), (args[1], _pattern(args[1])))
    if op == "regex-capture":
        _count(args, 3, least=True)
        if isinstance(args[2], bool) or not isinstance(args[2], int) or args[2] < 0:
            raise ExpressionError("the group of 'regex-capture' must be an unsigned integer")
        return Node(op, (sub(args[0]),), (args[1], _pattern(args[1]), args[2]))
    if op == "literal":
        _count(args, 1)
        return Node(op, given=_finite(args[0]))
    if op == "tag":
        _count(args, 1)
        return Node(op, given=_string(args[0], "the name of a tag"))
    if op in CONTEXT:
        _count(args, 0)
        return Node(op)
    raise ExpressionError(f"there is no operator {op!r}")


def _finite(x: Any) -> Any:
    """x; JSON has no infinite numbers."""
    if isinstance(x, float) and not math.isfinite(x):
        raise ExpressionError("a number is out of range")
    for part in x if isinstance(x, list) else x.values() if isinstance(x, dict) else ():
        _finite(part)
    return x


def _pattern(x: Any) -> str:
    try:
        return regex.translate(_string(x, "a pattern"))
    except regex.PatternError as e:
        raise ExpressionError(str(e)) from None


@dataclass(frozen=True)
class Context:
    """What an expression may ask for: a tag's value, the tag key at hand (None while features are judged), and the geometry type (None if unset).

    tags: the map that tags are looked up in, if they are in one.
    """

    tag: Callable[[str], V.Value]
    key: Column | None = None
    geometry_type: Column | None = None
    tags: Column | None = None

    @classmethod
    def of_columns(cls, kinds: Mapping[str, str], key: Column | None = None, geometry_type: Column | None = None, cols: Mapping[str, Column] | None = None) -> "Context":
        """Tags that are typed columns; kinds gives each one's kind."""
        return cls(lambda name: V.of_column((cols or {}).get(name, F.col(f"`{name}`")), kinds[name]) if name in kinds else V.null(), key, geometry_type)

    @classmethod
    def of_map(cls, tags: Column, key: Column | None = None, geometry_type: Column | None = None) -> "Context":
        """Tags in a map from names to tile values."""
        return cls(lambda name: V.of_mvt(F.try_element_at(tags, F.lit(name))), key, geometry_type, tags)


def value(node: Node, c: Context) -> V.Value:
    """The expression's value in a context."""
    boolean = lambda col: V.Value((V.BOOL,), V.BOOL, {V.BOOL: col})
    if node.op in COMPARISONS:
        return boolean(V.compare(node.op, value(node.args[0], c), value(node.args[1], c)))
    if node.op in LOGIC:
        hits = [condition(a, c) for a in node.args]
        if node.op == "all":
            return boolean(functools.reduce(operator.and_, hits, F.lit(True)) if hits else F.lit(True))
        any_of = functools.reduce(operator.or_, hits) if hits else F.lit(False)
        return boolean(any_of if node.op == "any" else ~any_of)
    if node.op == "not":
        return boolean(~condition(node.args[0], c))
    if node.op == "boolean":
        return boolean(condition(node.args[0], c))
    if node.op == "string":
        return V.string(V.text(value(node.args[0], c)))
    if node.op == "in":
        return boolean(V.member(value(node.args[0], c), node.given))
    if node.op in ("starts-with", "ends-with"):
        text = V.text(value(node.args[0], c))
        return boolean((text.startswith if node.op == "starts-with" else text.endswith)(node.given))
    if node.op == "regex-match":
        return boolean(V.text(value(node.args[0], c)).rlike(node.given[1]))
    if node.op == "regex-capture":
        return _capture(V.text(value(node.args[0], c)), *node.given)
    if node.op == "literal":
        return V.constant(node.given)
    if node.op == "tag":
        return c.tag(node.given)
    if node.op == "key":
        return V.null() if c.key is None else V.string(c.key)
    return V.null() if c.geometry_type is None else V.of_column(c.geometry_type, V.STR)


def _capture(text: Column, pattern: str, java: str, group: int) -> V.Value:
    """The group's text, or null where there is no match or the group takes no part in it."""
    parts = regex.groups(pattern)
    if group >= len(parts):
        return V.null()
    found = F.regexp_extract(text, java, group)
    if parts[group]:
        return V.of_column(F.when(text.rlike(java), found), V.STR)
    # of an empty text, whether the group took part or not: only then does a reference to it match
    return V.of_column(F.when(found != "", found).when(text.rlike(regex.taking_part(java, group)), F.lit("")), V.STR)


def condition(node: Node, c: Context) -> Column:
    """Whether the expression's value counts as true: a Column that is never NULL."""
    return V.truthy(value(node, c))


def tag_names(node: Node) -> set[str]:
    return ({node.given} if node.op == "tag" else set()).union(*map(tag_names, node.args))


def rule(node: Node, c: Context) -> Column:
    """condition of a whole rule. Of tags in a map, each is looked up and decoded once and bound for the rule, however often it is compared."""
    names = sorted(tag_names(node))
    if c.tags is None or not names:
        return condition(node, c)
    field = {name: f"t{k}" for k, name in enumerate(names)}
    found = F.array(F.struct(*(F.try_element_at(c.tags, F.lit(name)).alias(k) for name, k in field.items())))
    known = F.transform(found, lambda x: F.struct(*(V.decoded(x[k]).alias(k) for k in field.values())))
    return F.element_at(F.transform(known, lambda x: condition(node, Context(lambda name: V.of_decoded(x[field[name]]), c.key, c.geometry_type))), 1)


def compile_expression(doc: Any, c: Context, extensions: bool = False) -> Column:
    return rule(parse(doc, extensions), c)
