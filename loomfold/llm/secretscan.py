"""Secret scans: fixed patterns, and assignment-aware lexing.

A lexer reads source and configuration syntax into (name, value) assignments: `name = "x"`,
`name: x`, `"name": "x"`, `name := 'x'`, `export NAME=x`, `name => x`, `name: type = "x"`. A value is
a chain of literals and names joined by `+`, over line ends too, or side by side within brackets;
literals may have prefixes (`b"x"`); the elements of a list are values of its name. What a call or an
index gives is not known and no literal; its arguments are read by themselves. A value without
quotes is a literal if it can't be an identifier, or letters and digits alternate in it. An
apostrophe within or at the end of a word opens no string. Names are replaced by the literals they
were bound to, before or else after (constant propagation), however many. Each assignment is scored: what its name says (password, api key, ...) and
what the text of the value looks like (length, kinds of characters, entropy, placeholders). The
literals of an assignment that reaches the threshold are secrets, as are those that a sensitive
name reaches through other names.

Defined cases: a null text is empty and has no secrets; texts are scanned whole, in linear time; matches of a kind
don't overlap; a span found twice is listed once; repeated rows are scanned alike.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.llm.common import pick

# The base patterns, by kind, with the least length of the match (of group 2 for assign).
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
STEMS = ("password", "passwd", "secret", "token", "api_key", "apikey")

# Words of a name and what they add to its score.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "credential": 3, "credentials": 3, "apikey": 3, "privatekey": 3, "accesskey": 3, "key": 1, "api": 1, "auth": 1, "access": 1, "private": 1, "client": 1, "signing": 1, "encryption": 1, "master": 1, "bearer": 2, "salt": 1, "pass": 2, "public": -2, "count": -2, "length": -2, "max": -2, "min": -2, "limit": -2, "name": -2, "path": -2, "url": -1, "id": -1, "type": -2, "header": -1, "expiry": -2, "ttl": -2}
PLACEHOLDERS = re.compile(r"(?ai)^(?:changeme|change_me|example\w*|placeholder|none|null|nil|true|false|undefined|todo|test|dummy|sample|password|secret|token|your\w*|x+|\*+|\.+|<.*|\$\{?.*|\{\{.*|%\w.*|env\W.*|os\.\w.*|process\.env.*)$")
HINTS = re.compile("(?ai)" + "|".join(word for word, n in SENSITIVE.items() if n > 0))
LEAST_LITERAL, THRESHOLD = 8, 4.0

_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
_PREFIX = r"(?:(?:[bB][rR]?|[rR][bBfF]?|[fF][rR]?|[uU]|u8|L|[$]?@|[$])(?=[\"']))?"
# Kinds of strings: the opening quote, what may be inside, the closing quote.
QUOTED = {
    "triple": (r"\"{3}", r"(?:[^\"\\]|\\.|\"(?!\"\"))*+", r"\"{3}"),
    "triple_single": (r"'{3}", r"(?:[^'\\]|\\.|'(?!''))*+", r"'{3}"),
    "double": (r"\"", r"(?:[^\"\\\n]|\\.)*+", r"\""),
    "single": (r"'", r"(?:[^'\\\n]|\\.)*+", r"'(?!\w)"),
}
OPENED = {kind: re.compile(start + inner, re.S) for kind, (start, inner, _) in QUOTED.items()}
CLOSED = {kind: re.compile(end) for kind, (_, _, end) in QUOTED.items()}
STRINGS = tuple(QUOTED)


@functools.cache
def _lexeme(kinds: tuple[str, ...]) -> re.Pattern:
    """The lexemes, with strings of these kinds."""
    said = [rf"(?P<{k}>{'(?<!' + chr(92) + 'w)' if k == 'single' else ''}{_PREFIX}{''.join(QUOTED[k])})" for k in kinds]
    rest = rf"(?P<name>{_NAME})|(?P<number>[0-9][A-Za-z0-9_.]*)|(?P<comment>\#[^\n]*|//[^\n]*)|(?P<bind>:=|=>|=(?!=)|:(?!:))|(?P<plus>\+)|(?P<line>\n\s*)|(?P<other>[^\s])"
    return re.compile("|".join([*said, rest]), re.S)


class Lexer:
    """Lexemes of a text. A quote that opens no string is a lexeme by itself, and so are all of its kind up to where the
    search for its end stopped: that stretch is remembered, so that a text of open quotes takes linear time."""

    def __init__(self, text: str, end: int) -> None:
        self.text, self.end = text, end
        self.open = dict.fromkeys(STRINGS, (0, 0))
        self.past = 0  # the end of all these stretches

    def at(self, start: int) -> re.Match | None:
        shut = [k for k, (first, last) in self.open.items() if first <= start < last] if start < self.past else ()
        token = _lexeme(STRINGS if not shut else tuple(k for k in STRINGS if k not in shut)).search(self.text, start, self.end)
        if token is None:
            return None
        if shut and any(token.start() >= self.open[k][1] for k in shut):
            return self.at(token.start())
        if token[0] in ('"', "'", '""', "''"):
            for kind in STRINGS:
                tried = kind not in shut and OPENED[kind].match(self.text, token.start(), self.end)
                if tried and not CLOSED[kind].match(self.text, tried.end(), self.end):
                    self.open[kind] = token.start(), tried.end()
                    self.past = max(self.past, tried.end())
        return token


BARE = re.compile(r"""[^\s"',;#]+""")
BARE_INSIDE = re.compile(r"""[^\s"',;#)\]]+""")
# Pairs of a name and a literal that are no assignments: configuration elements, definitions by a call, template strings.
# Each stands with what a text must hold for it.
PAIRS = tuple((mark, re.compile(p)) for mark, p in (
    ("value", r"""(?i)<[\w:.-]+\s(?:[^<>]*?\s)?(?:key|name|id)\s*=\s*["'](?P<name>[\w.:-]{1,128})["']\s+value\s*=\s*(?:"(?P<a>[^"<>\n]+)"|'(?P<b>[^'<>\n]+)')"""),
    ("</", r"""<(?P<name>[A-Za-z_][\w.:-]{0,127})>(?P<a>[^<>\s]+)</(?P=name)>"""),
    ("define", r"""(?i)\bdefine\s*\(\s*["'](?P<name>\w{1,128})["']\s*,\s*(?:"(?P<a>[^"\n]+)"|'(?P<b>[^'\n]+)')"""),
    ("`", r"""(?<!\w)(?P<name>[A-Za-z_$]\w{0,127})["']?\s*[:=]\s*`(?P<a>[^`$\n]+)`"""),
))
PATH = r"[A-Za-z_$@][\w.]*(?:(?:::|->|\?\.)[A-Za-z_][\w.]*)*"
CALL = re.compile(PATH + r"(?=[(\[])")
IDENTIFIER = re.compile(rf"{PATH}|{_NAME}")
TURNS = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")

# A type between `:` and `=`; what stands in its brackets is taken out before FLAT_TYPE is matched.
TYPED = re.compile(r"[ \t]*([A-Za-z_&*][A-Za-z0-9_.<>\[\]|?!&*', \t]*+)=(?![=>])")
FLAT_TYPE = re.compile(r"&?(?:'[a-z]+[ ])?(?:mut[ ])?[*]?[A-Za-z_][A-Za-z0-9_.]*[?!]?(?:[ ]*\|[ ]*[A-Za-z_][A-Za-z0-9_.]*)*")
LITERAL = re.compile(rf"\s*[(\[]*\s*{_PREFIX}[\"']")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the fixed patterns."""
    out = []
    low = text.lower()
    if any(stem in low for stem in STEMS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)
    words = [w.lower() for w in words]
    pairs = [a + b for a, b in zip(words, words[1:])]
    return sum(SENSITIVE.get(w, 0) for w in words) + sum(SENSITIVE[p] for p in pairs if p in ("apikey", "privatekey", "accesskey"))


Weight = tuple[str, dict[str, int], int]
HEAD, WIDE = 64, 512


def weight(value: str) -> Weight:
    """What a value is scored by: its first characters, and how often each character is in it, in units of 2**shift."""
    return value[:HEAD], Counter(value), 0


def joined(weights: list[Weight]) -> Weight:
    """The weight of concatenated values. Counts of over WIDE bits (names doubled over and over) lose their last bits only."""
    head, shift, counts = "", max((w[2] for w in weights), default=0), Counter()
    for first, own, by in weights:
        head = (head + first)[:HEAD]
        for c, n in own.items():
            counts[c] += n >> shift - by
    over = sum(counts.values()).bit_length() - WIDE
    return (head, {c: n >> over for c, n in counts.items()}, shift + over) if over > 0 else (head, counts, shift)


def weight_score(of: Weight) -> float:
    """What a value's own characters say, from -9 (no secret) to about 3."""
    head, counts, shift = of
    length = sum(counts.values())
    # No placeholder is longer than HEAD but for a tail of any characters of a class: which ones there are is enough.
    said = head if not shift and length <= HEAD else head + "".join(counts)
    if not shift and length < LEAST_LITERAL or PLACEHOLDERS.match(said) or any(c.isspace() for c in counts):
        return -9.0
    kinds = sum(any(test(c) for c in counts) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    entropy = -sum(n / length * math.log2(n / length) for n in counts.values() if n)
    return min(kinds - 1, 2) + (1 if entropy >= 3 else 0 if entropy >= 2 else -2)


def value_score(value: str) -> float:
    return weight_score(weight(value))


def opaque(bare: str) -> bool:
    """Whether a value without quotes is a literal and no identifier: letters and digits alternate in what could be one."""
    return not IDENTIFIER.fullmatch(bare) or len(TURNS.findall(bare)) > 1


def _before_end(bare: str) -> str:
    """What stands before a bracket that closes one opened outside."""
    depth = 0
    for i, c in enumerate(bare):
        depth += (c in "([{") - (c in ")]}")
        if depth < 0:
            return bare[:i]
    return bare


Literal = tuple[int, int, str]
Part = tuple[str | None, Literal | None]


def _quotes(token: re.Match) -> int:
    return 3 if token.lastgroup.startswith("triple") else 1


def _typed(text: str, at: int) -> int | None:
    """The end of `type =`, if that is what stands after a colon."""
    found = TYPED.match(text, at)
    if not found:
        return None
    flat, depth = [], 0
    for c in found[1].rstrip():
        depth += c in "<["
        if not depth:
            flat.append(c)
        depth -= c in ">]"
    said = "".join(flat)
    if depth or not FLAT_TYPE.fullmatch(said):
        return None
    return found.end() if LITERAL.match(text, found.end()) or found[1][-1].isspace() and said.isascii() and not any(c.isdigit() for c in said) else None


def assignments(text: str, start: int = 0, end: int | None = None, known=()) -> Iterator[tuple[list[str], list[Part]]]:
    """(names, value) of each assignment. A value is a list of (name, literal): a name with what it says itself (start,
    end, text; None where the name may belong to other text), or None with a literal. `known` are names bound so far."""
    end = len(text) if end is None else end

    lexer = Lexer(text, end)

    def after(token):
        return lexer.at(token.end())

    def past_lines(token):
        while token is not None and token.lastgroup in ("line", "comment"):
            token = after(token)
        return token

    def bound_itself(token) -> bool:
        then = after(token)
        return then is not None and then.lastgroup == "bind"

    def inside(token) -> str:
        quote = _quotes(token)
        return token[0][min(i for i in (token[0].find('"'), token[0].find("'")) if i >= 0) + quote : -quote]

    names: list[str] = []
    words: list[str] = []  # the names in a row before this token
    level = 0  # brackets open
    frames: list[tuple] = []  # values in which a call or an index is open: (level, names, value, crossed, depth)
    token = lexer.at(start)
    while token is not None:
        kind, resumed = token.lastgroup, None
        if kind == "other" and token[0] in "([{":
            level += 1
        elif kind == "other" and token[0] in ")]}":
            level -= 1
            while frames and frames[-1][0] > level:
                _, names, value, _, _ = frames.pop()
                if value:
                    yield names, value
                names = []
            resumed = frames.pop() if frames and frames[-1][0] == level else None
        if resumed is not None:
            _, names, value, crossed, depth = resumed
            words, level, joins, token = [], level - depth, False, after(token)
        else:
            if kind == "name" or kind in ("double", "single") and re.fullmatch(_NAME, inside(token)):
                words = [*words[-2:], token[0] if kind == "name" else inside(token)]
                names = words[-2:] if len(words) == 3 and words[0] in ("var", "const") else words[-1:]  # `const key string =`, `const char key =`
                token = after(token)
                continue
            words = []
            if kind != "bind" or not names:
                sized = kind == "other" and token[0] == "[" and re.compile(r"[0-9]*\]").match(text, token.end())
                if not sized and not (kind == "number" and text[token.start() - 1 : token.start()] == "[" and text[token.end() : token.end() + 1] == "]"):
                    if kind != "other" or token[0] not in ")]":
                        names = []
                token = after(token)
                continue
            at = _typed(text, token.end()) if token[0] == ":" else None
            if at is not None:
                kind_of = text[token.end() : at - 1].strip()
                names = [*names, kind_of] if re.fullmatch(_NAME, kind_of) and name_score(kind_of) >= 2 else names  # prose: `said it: db_pwd = "x"`
            token = after(token) if at is None else lexer.at(at)
            first = past_lines(token)
            if first is not token and first is not None and first.lastgroup in STRINGS and not bound_itself(first):
                token = first
            value: list[Part] = []
            joins, crossed, depth = True, False, 0
        called = False
        while token is not None:
            kind = token.lastgroup
            if kind in ("line", "comment"):
                then = past_lines(token)
                if not (depth or joins and value or then is not None and then.lastgroup == "plus" and value):
                    break
                token, crossed = then, crossed or not depth
                continue
            if kind == "plus" and not joins:
                token, joins = after(token), True
                continue
            if kind == "other" and token[0] in "([" and joins:
                token, depth = after(token), depth + 1
                continue
            if kind == "other" and token[0] in ")]" and depth and not joins:
                token, depth = after(token), depth - 1
                continue
            if kind == "other" and token[0] == "," and depth:
                if value:
                    yield names, value
                token, value, joins = after(token), [], True
                continue
            if kind in STRINGS and (joins or depth):
                if bound_itself(token) and (value or depth or crossed):
                    break
                said = inside(token)
                stop = token.end() - _quotes(token)
                value.append((None, (stop - len(said), stop, said)))
            elif kind in ("name", "number") and joins:
                then = after(token)
                if then is not None and then.lastgroup == "bind" and kind == "name":
                    spaced = then.start() > token.end()
                    if then[0] in ("=", ":=") and not value and not depth and (spaced or LITERAL.match(text, then.end())):
                        names.append(token[0])  # a = b = "x"
                        token = after(then)
                        continue
                    if value or depth or crossed:
                        break
                call = CALL.match(text, token.start(), end)
                if call:
                    level += depth
                    frames.append((level, names, value, crossed, depth))
                    token, called = lexer.at(call.end()), True
                    break
                bare = (BARE_INSIDE if depth else BARE).match(text, token.start())[0]
                bare = _before_end(bare) if level > 0 else bare
                plain = kind == "name" and text[token.end() : token.end() + 1] == "+" and (token[0] in known or LITERAL.match(text, token.end() + 1))
                if not plain and not re.fullmatch(_NAME, bare):
                    if crossed:
                        break
                    if opaque(bare):
                        value.append((None, (token.start(), token.start() + len(bare), bare)))
                    token, joins = lexer.at(token.start() + len(bare)), False
                    continue
                value.append((token[0], (*token.span(), token[0]) if not crossed and opaque(token[0]) else None))
            else:
                break
            token, joins = after(token), False
        if not called:
            level += depth
            if value:
                yield names, value
        names = []
    for _, names, value, _, _ in frames:
        if value:
            yield names, value


class Bound:
    """What a name stands for: literals and other names' values, each held once."""

    __slots__ = ("parts", "_weight", "told")

    def __init__(self, parts: list) -> None:
        self.parts, self._weight, self.told = parts, None, False

    def weight(self) -> Weight:
        if self._weight is None:
            self._weight = joined([p.weight() if isinstance(p, Bound) else weight(p[2]) for p in self.parts])
        return self._weight

    def literals(self) -> Iterator[Literal]:
        """The literals reached that were not told before."""
        rest = [self]
        while rest:
            part = rest.pop()
            if not isinstance(part, Bound):
                yield part
            elif not part.told:
                part.told = True
                rest += part.parts


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals assigned to sensitive names, directly or through other names. HINTS finds every text with a name that scores at all."""
    if not any(mark in text for mark in ("=", ":", "`", "</")) and "define" not in text.lower() or not HINTS.search(text):
        return []
    out = list(paired(text))
    if "=" not in text and ":" not in text:
        return out
    later, open_names = _propagate(text, {}, out)
    if open_names & later.keys():  # names bound after their use
        _propagate(text, later, out)
    return out


def _propagate(text: str, later: dict[str, Bound], out: list) -> tuple[dict[str, Bound], set[str]]:
    """One pass; adds the literals found. Gives what names are bound to in the end, and names met before they were bound."""
    bound: dict[str, Bound] = {}
    open_names = set()
    for names, value in assignments(text, known=bound):
        parts = []
        for name, literal in value:
            held = bound.get(name) or later.get(name)
            if name is not None and name not in bound:
                open_names.add(name)
            if held is not None or literal is not None:
                parts.append(literal if held is None else held)
        made = Bound(parts)
        if any(isinstance(p, Bound) for p in parts):
            made.weight()  # now, so that long chains of names are never followed down
        for name in names:
            bound[name] = made
            said = name_score(name)
            if parts and said >= 2 and said + weight_score(made.weight()) >= THRESHOLD:
                out += [(a, b, "literal") for a, b, _ in made.literals() if b > a]
    return bound, open_names


def paired(text: str) -> Iterator[tuple[int, int, str]]:
    """Literals that PAIRS join to a sensitive name."""
    low = text.lower()
    for mark, pattern in PAIRS:
        for m in pattern.finditer(text) if mark in low else ():
            at = "a" if m["a"] is not None else "b"
            said = name_score(m["name"])
            if said >= 2 and said + value_score(m[at]) >= THRESHOLD:
                yield (*m.span(at), "literal")


def _order(span: tuple[int, int, str]) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def scan(text: str) -> tuple[list, list]:
    """Base spans, and all spans, in order."""
    base = base_spans(text)
    return sorted(base, key=_order), sorted(set(base + literal_spans(text)), key=_order)


def _said(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_FOUND = pa.struct([("base", pa.string()), ("spans", pa.string())])


@F.arrow_udf(T.StructType([T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]))
def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("base", "spans"), map(_said, scan(t.as_py() or "")))) for t in texts], _FOUND)


def scanned(text: Column) -> Column:
    """struct(base, spans): `kind:start:end` by start, comma-joined; code points, end exclusive."""
    return _scan(text)


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its id, the number of base findings by kind, base, spans."""
    found = pick(docs, doc_id, text).select(doc_id, scanned(F.col(text)).alias("f"))

    def number(kind: str) -> Column:  # a second argument of the lambda would be the element's place
        return F.size(F.filter(F.split("f.base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return found.select(doc_id, *[number(k) for k in KINDS[:3]], "f.base", "f.spans")


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, end, _ in scan(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


@F.arrow_udf(T.StringType())
def _redact(texts: pa.Array) -> pa.Array:
    return pa.array([None if (t := x.as_py()) is None else redact(t) for x in texts], pa.string())


def redacted(text: Column) -> Column:
    """The text without its secrets; null stays null."""
    return _redact(text)
