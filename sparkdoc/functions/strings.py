"""String and regular expression operators."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .core import BOOL, LONG, STRING, E, Scope, arguments, constant, fail_when, named, null_if_any, number, register, text, value

#: What $trim, $ltrim and $rtrim strip by default.
BLANKS = r"[\s\x00]"


@register("$concat")
def concat(spec: Any, scope: Scope) -> E:
    return E(F.concat(*[text(e, "$concat") for e in arguments(spec, scope, "$concat", 1)]), STRING)


def _utf8(s: Column) -> Column:
    return F.encode(s, "UTF-8")


@register("$substr", "$substrBytes")
def substr_bytes(spec: Any, scope: Scope) -> E:
    s, start, length = arguments(spec, scope, "$substrBytes", 3, 3)
    raw, at, n = _utf8(text(s, "$substrBytes")), number(start, "$substrBytes").col.cast("int"), number(length, "$substrBytes").col.cast("int")
    cut = F.substring(raw, at + 1, F.when(n < 0, F.octet_length(raw)).otherwise(n))
    return E(F.coalesce(F.decode(cut, "UTF-8"), F.lit("")), STRING)


@register("$substrCP")
def substr_cp(spec: Any, scope: Scope) -> E:
    s, start, length = arguments(spec, scope, "$substrCP", 3, 3)
    s, at, n = text(s, "$substrCP"), number(start, "$substrCP").col.cast("int"), number(length, "$substrCP").col.cast("int")
    return E(F.coalesce(F.substring(s, at + 1, n), F.lit("")), STRING)


def _length(name: str, measure) -> None:
    @register(name)
    def handler(spec: Any, scope: Scope) -> E:
        s = text(arguments(spec, scope, name, 1, 1)[0], name)
        return E(fail_when(s.isNull(), f"{name} needs a string", measure(s).cast(LONG)), LONG)


_length("$strLenBytes", F.octet_length)
_length("$strLenCP", F.char_length)


@register("$toLower")
def to_lower(spec: Any, scope: Scope) -> E:
    return E(F.coalesce(F.lower(text(arguments(spec, scope, "$toLower", 1, 1)[0], "$toLower")), F.lit("")), STRING)


@register("$toUpper")
def to_upper(spec: Any, scope: Scope) -> E:
    return E(F.coalesce(F.upper(text(arguments(spec, scope, "$toUpper", 1, 1)[0], "$toUpper")), F.lit("")), STRING)


@register("$strcasecmp")
def strcasecmp(spec: Any, scope: Scope) -> E:
    a, b = (F.lower(F.coalesce(text(e, "$strcasecmp"), F.lit(""))) for e in arguments(spec, scope, "$strcasecmp", 2, 2))
    return E(F.when(a < b, -1).when(a > b, 1).otherwise(0).cast(LONG), LONG)


def _trim(name: str, left: bool, right: bool) -> None:
    @register(name)
    def handler(spec: Any, scope: Scope) -> E:
        named(spec, name, ("input",), ("chars",))
        s = text(value(spec["input"], scope), name)
        if spec.get("chars") is None:
            ends = "|".join(["^" + BLANKS + "+"] * left + [BLANKS + "+$"] * right)
            return E(F.regexp_replace(s, "(?U)" + ends.replace("$", r"\z"), ""), STRING)
        chars = text(value(spec["chars"], scope), name)
        how = F.btrim if left and right else F.ltrim if left else F.rtrim
        return E(how(s, chars), STRING)


_trim("$trim", True, True)
_trim("$ltrim", True, False)
_trim("$rtrim", False, True)


@register("$split")
def split(spec: Any, scope: Scope) -> E:
    s, delimiter = (text(e, "$split") for e in arguments(spec, scope, "$split", 2, 2))
    quoted = F.concat(F.lit("\\Q"), F.replace(delimiter, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return E(fail_when(delimiter == "", "$split needs a separator", F.split(s, quoted, -1)), T.ArrayType(STRING))


@register("$replaceOne")
def replace_one(spec: Any, scope: Scope) -> E:
    s, find, put = (text(value(named(spec, "$replaceOne", ("input", "find", "replacement"))[k], scope), "$replaceOne") for k in ("input", "find", "replacement"))
    at = F.instr(s, find)
    new = F.concat(F.substring(s, F.lit(1), at - 1), put, F.substring(s, at + F.char_length(find), F.char_length(s)))
    return E(F.when(find.isNotNull() & put.isNotNull() & (at == 0), s).otherwise(new), STRING)


@register("$replaceAll")
def replace_all(spec: Any, scope: Scope) -> E:
    s, find, put = (text(value(named(spec, "$replaceAll", ("input", "find", "replacement"))[k], scope), "$replaceAll") for k in ("input", "find", "replacement"))
    return E(F.replace(s, find, put), STRING)


def _index(spec: Any, scope: Scope, name: str, in_bytes: bool) -> E:
    args = arguments(spec, scope, name, 2, 4)
    s, sub = text(args[0], name), text(args[1], name)
    size = F.octet_length(s) if in_bytes else F.char_length(s)
    start = number(args[2], name).col.cast("int") if len(args) > 2 else F.lit(0)
    end = F.least(number(args[3], name).col.cast("int"), size) if len(args) > 3 else size
    if in_bytes:
        window = F.decode(F.substring(_utf8(s), start + 1, F.greatest(end - start, F.lit(0))), "UTF-8")
        at = F.instr(window, sub)
        found = start + F.octet_length(F.substring(window, F.lit(1), at - 1))
    else:
        window = F.substring(s, start + 1, F.greatest(end - start, F.lit(0)))
        at = F.instr(window, sub)
        found = start + at - 1
    out = F.when((start > size) | (start > end), F.lit(-1)).when(at > 0, found).otherwise(F.lit(-1)).cast(LONG)
    return E(null_if_any([args[0]], fail_when(sub.isNull(), f"{name} needs a string to look for", out)), LONG)


@register("$indexOfBytes")
def index_of_bytes(spec: Any, scope: Scope) -> E:
    return _index(spec, scope, "$indexOfBytes", True)


@register("$indexOfCP")
def index_of_cp(spec: Any, scope: Scope) -> E:
    return _index(spec, scope, "$indexOfCP", False)


# --- regular expressions ---------------------------------------------------------------------------------------------


def java_regex(pattern: str, options: str = "") -> str:
    """A Python-style pattern with options i, m, s, x for Spark's engine."""
    if set(options) - set("imsxu"):
        raise QueryError(f"unknown regular expression options {options}")
    try:
        re.compile(pattern)
    except re.error as wrong:
        raise QueryError(f"bad regular expression: {wrong}") from wrong
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    flags = "".join(f for f in "imsx" if f in options) + "U"  # Python's classes are Unicode ones
    return f"(?{flags}{'u' if 'i' in options else ''})" + pattern


def plain_literal(pattern: str, options: str = "") -> tuple[str, str] | None:
    """("equals" | "prefix" | "suffix" | "contains", text) for patterns that are a literal with anchors: the optimizer
    can push such tests down, and they need no regular expression engine."""
    if options:
        return None
    body, head, tail = pattern, pattern.startswith("^"), False
    body = body[1:] if head else body
    if body.endswith("$") and not body.endswith("\\$"):
        return None  # $ also matches before a last line feed
    if body.endswith(r"\Z"):
        body, tail = body[:-2], True
    plain = re.sub(r"\\([^\w\s])", r"\1", body)
    if re.search(r"[.^$*+?{}\[\]|()\\]", re.sub(r"\\[^\w\s]", "", body)) or not plain:
        return None
    return ("equals" if head and tail else "prefix" if head else "suffix" if tail else "contains"), plain


def matches(s: Column, pattern: str, options: str = "") -> Column:
    known = plain_literal(pattern, options)
    if known:
        kind, body = known
        return {"equals": lambda: s == body, "prefix": lambda: s.startswith(body), "suffix": lambda: s.endswith(body), "contains": lambda: s.contains(body)}[kind]()
    return s.rlike(java_regex(pattern, options))


def _regex(spec: Any, scope: Scope, name: str) -> tuple[Column, str, str]:
    named(spec, name, ("input", "regex"), ("options",))
    pattern, options = constant(spec["regex"], name), constant(spec.get("options", ""), name) or ""
    if isinstance(pattern, re.Pattern):
        options = options or "".join(f for f, flag in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & flag)
        pattern = pattern.pattern
    if not isinstance(pattern, str):
        raise QueryError(f"{name} needs a pattern")
    return text(value(spec["input"], scope), name), pattern, options


@register("$regexMatch")
def regex_match(spec: Any, scope: Scope) -> E:
    s, pattern, options = _regex(spec, scope, "$regexMatch")
    return E(F.coalesce(matches(s, pattern, options), F.lit(False)), BOOL)


MATCH = T.StructType([T.StructField("match", STRING), T.StructField("idx", LONG), T.StructField("captures", T.ArrayType(STRING))])


def _all_matches(s: Column, pattern: str, options: str) -> Column:
    """Every match with its place: texts between matches and matches alternate, so places are running lengths."""
    java = java_regex(pattern, options)
    groups = re.compile(pattern).groups
    whole = F.regexp_extract_all(s, F.lit(java), F.lit(0))
    inner = [F.regexp_extract_all(s, F.lit(java), F.lit(g)) for g in range(1, groups + 1)]
    # the place of match k: the first occurrence of its text from the end of match k - 1 that the pattern also finds there
    start = F.struct(F.lit(0).cast(LONG).alias("at"), F.array().cast("array<bigint>").alias("idx"))

    def place(state: Column, m: Column) -> Column:
        rest = F.substring(s, (state["at"] + 1).cast("int"), F.char_length(s))
        here = state["at"] + F.greatest(F.regexp_instr(rest, F.lit(java)), F.lit(1)) - 1
        return F.struct((here + F.greatest(F.char_length(m), F.lit(1))).cast(LONG).alias("at"), F.concat(state["idx"], F.array(here.cast(LONG))).alias("idx"))

    idx = F.aggregate(whole, start, place)["idx"]
    numbers = F.sequence(F.lit(0), F.size(whole) - 1)
    one = lambda k: F.struct(F.get(whole, k).alias("match"), F.get(idx, k).alias("idx"), (F.array(*[F.get(g, k) for g in inner]) if inner else F.array().cast("array<string>")).alias("captures"))
    return F.when(F.size(whole) > 0, F.transform(numbers, one)).otherwise(F.array().cast(T.ArrayType(MATCH)))


@register("$regexFindAll")
def regex_find_all(spec: Any, scope: Scope) -> E:
    s, pattern, options = _regex(spec, scope, "$regexFindAll")
    return E(F.coalesce(F.when(s.isNotNull(), _all_matches(s, pattern, options)), F.array().cast(T.ArrayType(MATCH))), T.ArrayType(MATCH))


@register("$regexFind")
def regex_find(spec: Any, scope: Scope) -> E:
    s, pattern, options = _regex(spec, scope, "$regexFind")
    java = java_regex(pattern, options)
    groups = re.compile(pattern).groups
    at = F.regexp_instr(s, F.lit(java))
    captures = F.array(*[F.regexp_extract(s, java, g) for g in range(1, groups + 1)]) if groups else F.array().cast("array<string>")
    return E(F.when(at > 0, F.struct(F.regexp_extract(s, java, 0).alias("match"), (at - 1).cast(LONG).alias("idx"), captures.alias("captures"))), MATCH)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def glob_regex(pattern: str) -> str:
    """A file-name pattern (*, ?, [set]) as a regular expression for the whole text."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            inside = pattern[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            k = end
        else:
            out += {"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c, re.escape(c))
        k += 1
    return "^" + out + r"\z"


