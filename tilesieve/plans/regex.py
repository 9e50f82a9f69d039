"""Patterns of the filter language, a linear-time dialect, as patterns of java.util.regex."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException


class PatternError(ValueError):
    """A pattern that the filter language doesn't have."""


#: Named classes, which hold ASCII characters alone, as parts of a class.
NAMED = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}

#: Long names of Unicode's general categories.
CATEGORIES = {
    "letter": "L", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo", "mark": "M", "number": "N",
    "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No", "punctuation": "P", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "separator": "Z", "spaceseparator": "Zs", "control": "Cc", "format": "Cf", "other": "C",
}


def _escape(pattern: str, at: int) -> tuple[str, int]:
    """The escape that begins there, translated, and where it ends."""
    if at + 1 == len(pattern):
        raise PatternError("pattern ends with a backslash")
    n = pattern[at + 1]
    if n.isdigit() or n == "k" or n in "GZQE":
        raise PatternError(f"\\{n} is not supported")
    if n in "pP":
        if pattern[at + 2 : at + 3] != "{":
            return pattern[at : at + 3], at + 3
        end = pattern.find("}", at)
        name = pattern[at + 3 : end] if end > 0 else ""
        if name.startswith("^"):
            n, name = "P" if n == "p" else "p", name[1:]
        plain = re.sub(r"^(gc|general_category)=", "", name, flags=re.I)
        short = CATEGORIES.get(re.sub(r"[\s_-]", "", plain).lower(), plain)
        if not re.fullmatch(r"[\w=]+", short):
            raise PatternError(f"unknown class {name!r}")
        return f"\\{n}{{{short if '=' in short else 'Is' + short}}}", end + 1
    if n in "xu" and pattern[at + 2 : at + 3] == "{":
        end = pattern.find("}", at)
        return f"\\x{pattern[at + 2 : end + 1]}", end + 1
    return pattern[at : at + 2], at + 2


def _flags(found: str) -> str:
    """Flags of a group: there `u` is for classes of all Unicode and case, and `U` turns greed round."""
    if set(found) - set("imsux-"):
        raise PatternError(f"flags {found!r} are not supported")
    on, minus, off = found.partition("-")
    java = lambda x: "".join({"i": "iu", "u": "U"}.get(f, f) for f in x)
    return java(on) + (minus + java(off.replace("i", "")) + ("i" if "i" in off else "") if off else "")


def translate(pattern: str) -> str:
    """The pattern for Spark's functions, with the meaning that it has in filters.

    There, `$` is the end of the text alone, `.` is anything but a line feed, and classes know all of
    Unicode but for the named ones; look-around and references to groups are no part of the dialect.
    """
    out: list[str] = []
    at, depth, multiline = 0, 0, bool(re.search(r"\(\?[a-z]*m", pattern))
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            done, at = _escape(pattern, at)
            out.append(done)
            continue
        if depth:
            if c == "[" and pattern[at + 1 : at + 2] == ":":
                end = pattern.find(":]", at)
                name = pattern[at + 2 : end] if end > 0 else ""
                if name.removeprefix("^") not in NAMED:
                    raise PatternError(f"unknown class {name!r}")
                out.append(f"[{'^' * name.startswith('^')}{NAMED[name.removeprefix('^')]}]")
                at = end + 2
                continue
            depth += (c == "[") - (c == "]")
        elif c == "[":
            depth = 1
            out.append(c)
            at += 1
            if pattern[at : at + 1] == "^":
                out.append("^")
                at += 1
            if pattern[at : at + 1] == "]":  # first in a class it is an ordinary character
                out.append("\\]")
                at += 1
            continue
        elif c == "(" and pattern[at + 1 : at + 2] == "?":
            if re.match(r"\(\?(=|!|<=|<!|>|\()", pattern[at:]):
                raise PatternError("look-around is not supported")
            if m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[at:]):
                out.append("(")  # groups go by number
                at += m.end()
                continue
            if m := re.match(r"\(\?([A-Za-z-]*)([:)])", pattern[at:]):
                out.append(f"(?{_flags(m[1])}{m[2]}")
                at += m.end()
                continue
        elif c == "$" and not multiline:
            out.append(r"\z")
            at += 1
            continue
        elif c in "*+?}" and pattern[at + 1 : at + 2] == "+":
            raise PatternError("possessive repetition is not supported")
        out.append(c)
        at += 1
    java = "(?dU)" + "".join(out)
    _check(java, pattern)
    return java


def _check(java: str, pattern: str) -> None:
    """Spark's own engine must accept the pattern; without a session, that comes when the rule runs."""
    context = SparkContext._active_spark_context
    if context is None or context._jvm is None:
        return
    try:
        context._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, IllegalArgumentException) as e:
        raise PatternError(f"invalid pattern {pattern!r}: {e}") from None


def taking_part(java: str, group: int) -> str:
    """A pattern that matches a text if the group takes part, with an empty text, in the first match of a translated pattern.

    The atomic part finds that match and no other; a reference to a group that took no part fails.
    """
    return rf"(?dU)\A(?>[\s\S]*?(?:{java.removeprefix('(?dU)')}))\{group}"


def groups(pattern: str) -> list[bool]:
    """For each capturing group, by number: whether it takes part in every match. The whole match is the first entry."""
    flags, stack = [True], []
    at, in_class, alternatives = 0, False, False
    spans: list[tuple[int, int, int]] = []  # group number or 0, start, end
    bars: list[int] = []
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            at += 1 + (pattern[at + 1 : at + 2] == "^")
            at += pattern[at : at + 1] == "]"
            continue
        elif c == "(":
            capturing = pattern[at + 1 : at + 2] != "?" or re.match(r"\(\?P?<[A-Za-z_]", pattern[at:]) is not None
            if capturing:
                flags.append(True)
            stack.append((len(flags) - 1 if capturing else 0, at))
        elif c == ")" and stack:
            number, start = stack.pop()
            spans.append((number, start, at))
        elif c == "|":
            bars.append(at)
        at += 1
    optional = []
    for _, start, end in spans:
        if re.match(r"[?*]|\{0?,|\{0\}", pattern[end + 1 :]):
            optional.append((start, end))
    for bar in bars:
        around = [(s, e) for _, s, e in spans if s < bar < e]
        optional.append(max(around, default=(-1, len(pattern))))
    for number, start, end in spans:
        if number and any(s <= start and end <= e and ((s, e) != (start, end) or re.match(r"[?*]|\{0?,|\{0\}", pattern[end + 1 :])) for s, e in optional):
            flags[number] = False
    return flags
