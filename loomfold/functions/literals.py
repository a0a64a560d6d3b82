"""Cells that hold Python literals, and documents in extended JSON, as JSON text.

`histories` reads cells of literals separated by semicolons: common forms become JSON, others go through a recursive-descent parser;
`unwrapped` takes the wrappers of ids, numbers and dates off at every level, with column functions only."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s*(?:(?P<string>[uUrRbB]{0,2}(?:'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"))|(?P<number>[+-]?(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][\w.]*)|(?P<mark>[][{}(),:;])|(?P<bad>\S))""", re.S)
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{1,3})|(.))", re.S)
# What a character after a backslash stands for, and the names of constants.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "\\": "\\", "'": "'", '"': '"', "\n": ""}
CONSTANTS = {"None": None, "True": True, "False": False}
DEEPEST = 200


class Bad(ValueError):
    """No literal."""


def _text(token: str) -> str:
    first = min(i for i in (token.find("'"), token.find('"')) if i >= 0)
    prefix, said = token[:first].lower(), token[first + 1 : -1]
    if "b" in prefix:
        raise Bad("bytes")
    if "r" in prefix:
        return said

    def escaped(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code or m[4]:
            number = int(code, 16) if code else int(m[4], 8)
            if number > 0x10FFFF or 0xD800 <= number < 0xE000:
                raise Bad("code point")
            return chr(number)
        if m[5] in "xuUN":
            raise Bad("escape")
        return ESCAPES.get(m[5], m[0])

    return _ESCAPE.sub(escaped, said)


class _Never(Bad):
    """What stands in no literal."""


class _Parser:
    def __init__(self, text: str):
        self.tokens = [(m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(text)]
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if mark is not None and token != ("mark", mark):
            raise Bad(mark)
        self.at += 1
        return token

    def value(self, depth: int = 0):
        kind, said = self.take()
        if depth > DEEPEST:
            raise Bad("depth")
        if kind == "string":
            out = _text(said)
            while self.peek()[0] == "string":  # neighbours are one
                out += _text(self.take()[1])
            return out
        if kind == "number":
            if re.fullmatch(r"[+-]?\d+(?:_\d+)*", said):
                if re.fullmatch(r"[+-]?0+[1-9_]\d*", said.replace("_", "")):
                    raise Bad("leading zero")
                return int(said)
            if "_" in said:
                raise Bad("number")
            return float(said)
        if kind == "name" and said in CONSTANTS:
            return CONSTANTS[said]
        if kind == "name" and self.peek() == ("mark", "("):
            self.take()
            return self.made(said, self.items(")", depth))
        if (kind, said) == ("mark", "["):
            return self.items("]", depth)
        if (kind, said) == ("mark", "("):
            start = self.at
            out = self.items(")", depth)
            return out[0] if len(out) == 1 and self.tokens[self.at - 2] != ("mark", ",") and self.at - start > 1 else out
        if (kind, said) == ("mark", "{"):
            return self.pairs(depth)
        raise Bad(said)

    def items(self, last: str, depth: int) -> list:
        out = []
        while self.peek() != ("mark", last):
            out.append(self.value(depth + 1))
            if self.peek() != ("mark", last):
                self.take(",")
        self.take(last)
        return out

    def pairs(self, depth: int) -> dict:
        out = {}
        while self.peek() != ("mark", "}"):
            key = self.value(depth + 1)
            if isinstance(key, (list, dict)):
                raise Bad("key")
            self.take(":")
            out[key] = self.value(depth + 1)
            if self.peek() != ("mark", "}"):
                self.take(",")
        self.take("}")
        return out

    def made(self, name: str, values: list):
        """Dates, with their numbers as they stand, and ids."""
        if name == "datetime.datetime" and 6 <= len(values) <= 7 and all(type(v) is int for v in values):
            return "{}-{}-{} {}:{}:{}".format(*values)
        if name == "ObjectId" and len(values) == 1 and isinstance(values[0], str):
            return values[0]
        raise Bad(name)


def literal(text: str):
    """The value of one literal; raises Bad for anything else."""
    parser = _Parser(text)
    out = parser.value()
    if parser.peek()[0] != "end":
        raise Bad("more")
    return out


def _slow(cell: str) -> list[dict]:
    out, parser = [], _Parser(cell)
    while parser.peek()[0] != "end":
        start = parser.at
        try:
            value = parser.value()
            if parser.peek() not in (("mark", ";"), ("end", "")):
                raise Bad("more")
            if isinstance(value, dict):
                out.append(value)
        except Bad:
            parser.at = start
            while parser.peek() not in (("mark", ";"), ("end", "")):
                parser.at += 1
        parser.at += 1
    return out


_PREFIX = "[uUrRbB]{0,2}"
_QUOTED = r"""(?:'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+")"""
_PART = re.compile(rf"""(?:[^'";]++|{_QUOTED})*+""", re.S)
_ONE = re.compile(_PREFIX + _QUOTED, re.S)
_SIMPLE = r"(?:None|True|False|-?[0-9][0-9.eE+-]*+)"
_COMMON = re.compile(
    rf"""(?P<plain>(?:'[^'"\\\x00-\x1f]*+'(?!\s*{_PREFIX}['"])|[\]}}\s]|[\[{{:](?!\s*,)|,(?!\s*[\]}},]))++)|(?P<run>{_PREFIX}{_QUOTED}(?:\s*{_PREFIX}{_QUOTED})*+)|datetime\.datetime\((?P<date>(?:0|[1-9][0-9]*+)(?:,[ ]?(?:0|[1-9][0-9]*+)){{5,6}})\)"""
    rf"""|ObjectId\('(?P<id>[^'"\\\x00-\x1f]*+)'\)|\((?P<tuple>{_SIMPLE}(?:,[ ]?{_SIMPLE})++)\)|(?P<number>[+-]?\.?\d[\w.+-]*+)|(?P<name>[A-Za-z_][\w.]*+)|(?P<wrong>[()]|[\[{{,:]\s*,)|(?P<comma>,\s*(?=[\]}}]))""", re.S)
_NAMES = {"None": "null", "True": "true", "False": "false"}


def _as_json(m: re.Match) -> str:
    """The JSON text of a token in one of the common forms; raises Bad for others."""
    kind = m.lastgroup
    if kind == "plain":
        return m[0].replace("'", '"')
    if kind == "run":
        return json.dumps("".join(map(_text, _ONE.findall(m[0]))), ensure_ascii=False)
    if kind == "name":
        if m[0] not in _NAMES:
            raise Bad(m[0])
        return _NAMES[m[0]]
    if kind == "date":
        return '"{}-{}-{} {}:{}:{}"'.format(*m["date"].replace(" ", "").split(","))
    if kind == "id":
        return f'"{m["id"]}"'
    if kind == "tuple":
        return "[" + ",".join(_NAMES.get(x, x) for x in m["tuple"].replace(" ", "").split(",")) + "]"
    if kind == "number":
        if ".." in m[0]:
            raise _Never(m[0])
        return m[0]
    if kind == "comma":
        return ""
    raise Bad(m[0])


def history(cell: str | None) -> list[dict]:
    """The dicts of a cell, separated by semicolons (those within strings separate nothing); others are left out.

    Parts in the common forms become JSON by one expression and are read as such; JSON is stricter, so what is
    left of anything else fails there, and the parser reads the part."""
    out, at, cell = [], 0, cell or ""
    while at < len(cell):
        end = _PART.match(cell, at).end()
        if end < len(cell) and cell[end] != ";":  # a quote without its other
            return out + _slow(cell[at:])
        part, at = cell[at:end], end + 1
        try:
            if part.count("[") + part.count("{") > DEEPEST:
                raise Bad("depth")
            value = json.loads(_COMMON.sub(_as_json, part))
            if isinstance(value, dict):
                out.append(value)
        except _Never:
            pass
        except ValueError:  # also Bad
            out += _slow(part)
    return out


def _json(value) -> str | None:
    try:
        return json.dumps(value, ensure_ascii=False, allow_nan=False)
    except ValueError:  # infinite
        return None


@F.arrow_udf(T.StringType())
def _histories(cells: pa.Array) -> pa.Array:
    return pa.array([_json(history(c.as_py())) for c in cells], pa.string())


def histories(cell: Column) -> Column:
    """A JSON array of the dicts in a cell; an empty one for a null or empty cell."""
    return _histories(cell)


def _literal_json(cell: str | None) -> str | None:
    try:
        return None if cell is None else _json(literal(cell))
    except Bad:
        return None


@F.arrow_udf(T.StringType())
def _literals(cells: pa.Array) -> pa.Array:
    return pa.array([_literal_json(c.as_py()) for c in cells], pa.string())


def as_json(cell: Column) -> Column:
    """The one literal of a cell as JSON; null for a null cell or one that is no literal."""
    return _literals(cell)


_STRING = r'"(?:[^"\\]|\\.)*"'


def iso_millis(millis: Column) -> Column:
    """Milliseconds since 1970 as an ISO time in UTC, with microseconds if there are any."""
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (millis.cast("decimal(20,0)") / 1000).cast("decimal(18,6)"))
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since  # no time zone takes part
    rest = F.pmod(millis, F.lit(1000))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest != 0, F.format_string(".%03d000", rest)).otherwise(""), F.lit("+00:00"))


def unwrapped(document: Column) -> Column:
    """A document in extended JSON with {"$oid": …}, {"$numberInt": …}, {"$numberLong": …}, {"$numberDouble": …} and
    {"$date": …} replaced at every level by id, number and ISO time: JSON with sorted keys and no blanks; null for bad JSON.

    A wrapper is an object with this key only. It never stands inside a string, where its quotes would be escaped."""
    out = F.to_json(F.try_parse_json(document))
    out = F.regexp_replace(out, rf'\{{"\$oid":({_STRING})\}}', "$1")
    out = F.regexp_replace(out, r'\{"\$number(?:Int|Long)":"?(-?[0-9]+)"?\}', "$1")
    out = F.regexp_replace(out, r'\{"\$numberDouble":"?(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"?\}', "$1")
    out = F.regexp_replace(out, rf'\{{"\$date":({_STRING})\}}', "$1")
    date = r'\{"\$date":(-?[0-9]+)\}'

    def dated(text: Column) -> Column:
        said = F.transform(F.regexp_extract_all(text, F.lit(date), F.lit(1)), lambda m: F.concat(F.lit('"'), iso_millis(m.cast("long")), F.lit('"')))
        whole = F.zip_with(F.split(text, date), said, lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
        return F.when(text.contains('{"$date":'), F.array_join(whole, "")).otherwise(text)

    return F.element_at(F.transform(F.array(out), dated), 1)  # bound to a name, so that it is computed once
