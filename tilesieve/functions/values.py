"""Values of the filter language as Columns.

A value is null, a boolean, an integer, a float, a string or (as a constant only) an array. A `Value`
knows which of these it can be, so that comparisons of, say, a string column with a string constant
become one plain predicate, and only values of unknown kind are dispatched at run time. Every Column
built here is total: it is never SQL NULL, whatever the data hold.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, BOOL, INT, FLOAT, STR, ARRAY = "null", "bool", "int", "float", "str", "array"

#: The slots of a tile's tag value in order of precedence, with the kind that each has.
SLOTS = {"string_value": STR, "int_value": INT, "uint_value": INT, "sint_value": INT, "float_value": FLOAT, "double_value": FLOAT, "bool_value": BOOL}

MVT_VALUE = "struct<string_value:string,float_value:float,double_value:double,int_value:bigint,uint_value:decimal(20,0),sint_value:bigint,bool_value:boolean>"


@dataclass(frozen=True)
class Value:
    """Columns of each kind that a value can have; `kind` tells which one holds, or is a plain string if there is one only."""

    kinds: tuple[str, ...]
    kind: Column | str
    cols: dict[str, Column] = field(default_factory=dict)
    constant: Any = None
    text: Column | None = None  # of a float constant, as it was written

    @property
    def only(self) -> str | None:
        """The kind of a value that can have one alone."""
        return self.kind if isinstance(self.kind, str) else None

    @property
    def is_constant(self) -> bool:
        return self.only == NULL or self.only is not None and self.constant is not None

    def has(self, kind: str) -> Column:
        if isinstance(self.kind, str):
            return F.lit(self.kind == kind)
        return self.kind == F.lit(kind)


def null() -> Value:
    return Value((NULL,), NULL)


def number_text(x: Any) -> str:
    """A number of a JSON document as the document's reader prints it."""
    if isinstance(x, int):
        return str(x)
    if x == int(x) and abs(x) < 1e16:
        return f"{x:.1f}"
    digits, _, power = repr(x).partition("e")
    if not power:
        return digits
    if power == "-05":  # still written without an exponent
        sign, plain = ("-", digits[1:]) if x < 0 else ("", digits)
        return f"{sign}0.0000{plain.replace('.', '')}"
    return f"{digits}e{int(power)}"


def constant_text(x: Any) -> str:
    """Display form of a constant."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return number_text(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(constant_text, x)) + "]"
    if isinstance(x, dict):
        return json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    return x


def constant(x: Any) -> Value:
    """A constant of a JSON document. An object becomes its JSON text; an integer beyond 64 bits a float."""
    if x is None:
        return null()
    if isinstance(x, bool):
        return Value((BOOL,), BOOL, {BOOL: F.lit(x)}, x)
    if isinstance(x, int) and -(2**63) <= x < 2**63:
        return Value((INT,), INT, {INT: F.lit(x).cast("long")}, x)
    if isinstance(x, (int, float)):
        return Value((FLOAT,), FLOAT, {FLOAT: F.lit(float(x))}, x, F.lit(number_text(x)))
    if isinstance(x, list):
        return Value((ARRAY,), ARRAY, {}, x)
    text = constant_text(x)
    return Value((STR,), STR, {STR: F.lit(text)}, text)


def of_column(col: Column, kind: str) -> Value:
    """A typed column in which SQL NULL means a missing tag. 32-bit floats must be widened by their text first."""
    return Value((NULL, kind), F.when(col.isNull(), NULL).otherwise(kind), {kind: col})


def string(col: Column) -> Value:
    """A string column without NULLs."""
    return Value((STR,), STR, {STR: col})


def of_mvt(tag: Column) -> Value:
    """A tile's tag value (MVT_VALUE, NULL if missing): the first slot that is set counts; none set is null."""
    kind = F.lit(NULL)
    for slot, k in reversed(SLOTS.items()):
        kind = F.when(tag[slot].isNotNull(), k).otherwise(kind)
    # an unsigned integer above the signed range wraps around
    wide = tag["uint_value"]
    wrapped = F.when(wide > F.lit(2**63 - 1), (wide - F.lit(str(2**64)).cast("decimal(20,0)")).cast("long")).otherwise(F.when(wide <= F.lit(2**63 - 1), wide).cast("long"))
    # a 32-bit float counts by its shortest decimal text
    widened = tag["float_value"].cast("string").cast("double")
    cols = {
        STR: tag["string_value"],
        INT: F.coalesce(tag["int_value"], wrapped, tag["sint_value"]),
        FLOAT: F.coalesce(widened, tag["double_value"]),
        BOOL: tag["bool_value"],
    }
    return Value((NULL, BOOL, INT, FLOAT, STR), kind, cols)


def decoded(tag: Column) -> Column:
    """of_mvt as a struct: kind, and a column of each kind."""
    v = of_mvt(tag)
    return F.struct(v.kind.alias("kind"), *(v.cols[k].alias(k) for k in (BOOL, INT, FLOAT, STR)))


def of_decoded(x: Column) -> Value:
    """A struct that decoded made."""
    return Value((NULL, BOOL, INT, FLOAT, STR), x["kind"], {k: x[k] for k in (BOOL, INT, FLOAT, STR)})


def float_text(x: Column) -> Column:
    """A double as the shortest decimal that reads back, without an exponent: 5, 0.1, 1000000000000000000000."""
    s = x.cast("string")
    body = F.regexp_replace(s, "^-", "")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(body, "E.*$", ""), r"\.0$|\.", "")
    power = F.coalesce(F.expr("0").cast("int") + F.when(body.contains("E"), F.regexp_extract(body, r"E(-?\d+)$", 1)).otherwise("0").cast("int"), F.lit(0))
    after = F.length(digits) - 1
    large = F.when(power >= after, F.concat(digits, F.repeat(F.lit("0"), power - after))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    tiny = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    expanded = F.concat(sign, F.when(power < 0, tiny).otherwise(large))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(s.contains("E"), expanded).otherwise(F.regexp_replace(s, r"\.0$", ""))


def text(v: Value) -> Column:
    """Display form of a value."""
    if v.is_constant:
        return F.lit(constant_text(v.constant))
    of = {NULL: lambda: F.lit("null"), BOOL: lambda: F.when(v.cols[BOOL], "true").otherwise("false"), INT: lambda: v.cols[INT].cast("string"), FLOAT: lambda: float_text(v.cols[FLOAT]), STR: lambda: v.cols[STR]}
    return _by_kind(v, {k: of[k]() for k in v.kinds}, F.lit("null"))


def truthy(v: Value) -> Column:
    """A boolean is itself; a string or array counts unless it is empty, a number unless it is 0; null doesn't."""
    if v.only == ARRAY:
        return F.lit(bool(v.constant))
    if v.is_constant and v.only == FLOAT:
        return F.lit(constant_text(v.constant) not in ("0", "0.0"))
    of = {
        NULL: lambda: F.lit(False),
        BOOL: lambda: v.cols[BOOL],
        INT: lambda: v.cols[INT] != 0,
        # minus zero is written -0, which counts, and so does NaN
        FLOAT: lambda: (v.cols[FLOAT] != 0) | (v.cols[FLOAT].cast("string") == "-0.0"),
        STR: lambda: v.cols[STR] != "",
    }
    return _by_kind(v, {k: of[k]() for k in v.kinds}, F.lit(False))


def _by_kind(v: Value, of: dict[str, Column], default: Column) -> Column:
    if isinstance(v.kind, str):
        return of[v.kind]
    if len(of) == 2 and NULL in of:  # a typed column
        (k,) = (k for k in of if k != NULL)
        return F.when(v.cols[k].isNotNull(), of[k]).otherwise(of[NULL])
    out = default
    for k in reversed(v.kinds):
        out = F.when(v.has(k), of[k]).otherwise(out)
    return out


_OPS: dict[str, Callable[[Any, Any], Any]] = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def _pair(op: str, a: Value, b: Value, ka: str, kb: str) -> Column:
    """The comparison for one pair of kinds, whose Columns are then not NULL."""
    f = _OPS[op]
    if NULL in (ka, kb):
        return F.lit(bool(f(ka != NULL, kb != NULL)))  # null is below everything else
    if ka == kb and ka in (BOOL, INT, STR):
        return f(a.cols[ka], b.cols[kb])
    if {ka, kb} <= {INT, FLOAT}:
        x, y = a.cols[ka].cast("double"), b.cols[kb].cast("double")
        # NaN is as large as whatever it is compared with
        odd = [F.isnan(v) for v, k, side in ((x, ka, a), (y, kb, b)) if k == FLOAT and not (side.is_constant and not math.isnan(side.constant))]
        plain = f(x, y)
        return F.when(functools.reduce(operator.or_, odd), F.lit(bool(f(0, 0)))).otherwise(plain) if odd else plain
    one = lambda v, k: text(v) if v.is_constant or len(v.kinds) == 1 else text(Value((k,), k, {k: v.cols[k]}))
    return f(one(a, ka), one(b, kb))


def compare(op: str, a: Value, b: Value) -> Column:
    """a op b for any kinds: numbers as numbers, strings by bytes, null lowest, and other mixtures by display form."""
    if op == "==" and set(a.kinds) | set(b.kinds) <= {NULL, STR} and STR in a.kinds and STR in b.kinds:
        return a.cols[STR].eqNullSafe(b.cols[STR])  # a form that reaches the scan
    out: Column | None = None
    for ka in a.kinds:
        for kb in b.kinds:
            hit = _pair(op, a, b, ka, kb)
            conditions = [v.has(k) for v, k in ((a, ka), (b, kb)) if not isinstance(v.kind, str)]
            if not conditions:
                return hit
            where = functools.reduce(operator.and_, conditions)
            out = F.when(where, hit) if out is None else out.when(where, hit)
    return out.otherwise(F.lit(False))


def member(v: Value, items: list[Any]) -> Column:
    """Membership without conversion: kinds must be the same, and floats are compared as they are written."""

    def kind_of(x: Any) -> str:
        return constant(x).kind if not isinstance(x, list) else ARRAY

    by: dict[str, list[Any]] = {}
    for x in items:
        by.setdefault(kind_of(x), []).append(x)
    if v.only == ARRAY:
        return F.lit(any(_same(v.constant, x) for x in by.get(ARRAY, [])))
    of: dict[str, Column] = {}
    for k in v.kinds:
        have = by.get(k, [])
        if not have:
            of[k] = F.lit(False)
        elif k == NULL:
            of[k] = F.lit(True)
        elif k == FLOAT:
            of[k] = (F.lit(constant_text(v.constant)) if v.is_constant else float_text(v.cols[FLOAT])).isin([constant_text(x) for x in have])
        elif k == STR:
            of[k] = v.cols[STR].isin([constant_text(x) for x in have])
        else:
            of[k] = v.cols[k].isin(have)
    return _by_kind(v, of, F.lit(False))


def _same(a: Any, b: Any) -> bool:
    """Structural equality of constants: 1, 1.0, true and "1" all differ."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return constant(a).kind == constant(b).kind and constant_text(a) == constant_text(b) if not (isinstance(a, list) or isinstance(b, list)) else False
