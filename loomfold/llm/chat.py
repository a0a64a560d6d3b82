"""Chat formatting: a small sandboxed template language, compiled to Python closures.

    {{ m.text | escape }}                         an expression, with filters
    {% for m in messages %} ... {% endfor %}      also loop.first, loop.last, loop.index0 inside
    {% if m.role == 'user' and loop.first %} ... {% elif ... %} ... {% else %} ... {% endif %}
    {% set x = expression %}
    {% generation %} ... {% endgeneration %}      what the model is to produce: the loss mask

A `-` inside a tag's braces (`{%-`, `-%}`, `{{-`, `-}}`, `{#-`, `-#}`) takes the white space beside it.

Expressions have strings, numbers, true, false, none, names, .field, [index], + (joins), ==, !=, <,
>, and, or, not, `in`, parentheses and the filters of FILTERS. Fields are looked up in mappings
only, so a template reaches nothing but the messages and variables given. A template is parsed to a
syntax tree; constants are folded (joins and comparisons of literals, filters on literals,
conditions that are always true or false, neighbouring text), then each node becomes a closure.

Texts are escaped so that no control string occurs inside one: a backslash is doubled and one is
put behind the first character of each control string; `unescape` takes them out again.

Defined cases: a null role or text is empty; turns go by turn, then role, then text (null first);
repeated rows are turns of their own; rows with a null conv_id form one conversation, one row as any other (filter them out where the id is
missing for very many); an empty
table has no conversations. A conversation is one output row and is held by one task; the rows of
different conversations stream through sorted partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.llm.common import pick

# The control strings of this template, and those of other common ones.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>\n{% endfor %}"
)

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str}

_PIECE = re.compile(r"\{\{-?(?P<out>.*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}|\{#-?.*?-?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[<>+.|()\[\]=,]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; trees are tuples, ('const', value) for literals."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.joined()
        while op := self.take("==", "!=", "<", ">", "in"):
            left = ("op", op, left, self.joined())
        return left

    def joined(self) -> tuple:
        left = self.filtered()
        while self.take("+"):
            left = ("op", "+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        tree = self.reached()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def reached(self) -> tuple:
        tree = self.plain()
        while True:
            if self.take("."):
                tree = ("get", tree, ("const", self.name()))
            elif self.take("["):
                tree = ("get", tree, self.either())
                self.need("]")
            else:
                return tree

    def plain(self) -> tuple:
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, said = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), said[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(said))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[said]) if said in ("true", "false", "none") else ("name", said)
        raise TemplateError(f"unexpected {said!r}")


def parse(template: str) -> list[tuple]:
    """Syntax tree: a list of nodes ('text', s), ('out', e), ('set', name, e), ('if', [(e, body)...]), ('for', name, e, body), ('mark', body)."""
    root: list[tuple] = []
    stack: list[tuple[str, object]] = [("", root)]
    body, at = root, 0
    trim = False
    for m in _PIECE.finditer(template):
        plain = template[at : m.start()].lstrip() if trim else template[at : m.start()]
        plain = plain.rstrip() if m[0][2] == "-" else plain
        if plain:
            body.append(("text", plain))
        at, trim = m.end(), m[0][-3] == "-"
        if m["out"] is not None:
            body.append(("out", _Expression(m["out"]).whole()))
        if m["tag"] is None:
            continue
        word, _, rest = m["tag"].strip().partition(" ")
        inside = stack[-1][0]
        if word == "for":
            name, _, source = rest.partition(" in ")
            node: tuple = ("for", name.strip(), _Expression(source).whole(), [])
            body.append(node)
            stack.append(("for", body))
            body = node[3]
        elif word == "generation":
            node = ("mark", [])
            body.append(node)
            stack.append(("generation", body))
            body = node[1]
        elif word == "if":
            node = ("if", [(_Expression(rest).whole(), [])])
            body.append(node)
            stack.append(("if", body))
            body = node[1][0][1]
        elif word in ("elif", "else") and inside == "if":
            branches = stack[-1][1][-1][1]
            branches.append((_Expression(rest).whole() if word == "elif" else ("const", True), []))
            body = branches[-1][1]
        elif word == "set":
            name, _, source = rest.partition("=")
            body.append(("set", name.strip(), _Expression(source).whole()))
        elif word == f"end{inside}" and inside:
            body = stack.pop()[1]
        else:
            raise TemplateError(f"unexpected tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not closed")
    plain = template[at:].lstrip() if trim else template[at:]
    if plain:
        body.append(("text", plain))
    return root


_OPERATIONS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "in": lambda a, b: a in b, "+": lambda a, b: a + b}


def fold(tree: tuple) -> tuple:
    """The expression with constant parts worked out."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "op":
        left, right = fold(tree[2]), fold(tree[3])
        if left[0] == right[0] == "const":
            return ("const", _OPERATIONS[tree[1]](left[1], right[1]))
        return ("op", tree[1], left, right)
    if kind == "filter":
        inner = fold(tree[2])
        return ("const", FILTERS[tree[1]](inner[1])) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind == "not":
        inner = fold(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    left, right = fold(tree[1]), fold(tree[2])
    if kind in ("and", "or") and left[0] == "const":
        return right if bool(left[1]) == (kind == "and") else left
    return (kind, left, right)


def fold_body(body: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "out":
            tree = fold(node[1])
            node = ("text", _said(tree[1])) if tree[0] == "const" else ("out", tree)
        elif kind == "set":
            node = ("set", node[1], fold(node[2]))
        elif kind == "for":
            node = ("for", node[1], fold(node[2]), fold_body(node[3]))
        elif kind == "mark":
            node = ("mark", fold_body(node[1]))
        elif kind == "if":
            branches = []
            for test, inner in node[1]:
                test = fold(test)
                if test == ("const", False):
                    continue
                branches.append((test, fold_body(inner)))
                if test[0] == "const" and test[1]:
                    break
            if branches and branches[0][0][0] == "const" and branches[0][0][1]:
                for inner in branches[0][1]:
                    _add(out, inner)
                continue
            node = ("if", branches)
        _add(out, node)
    return out


def _add(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def _said(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "op":
        run, left, right = _OPERATIONS[tree[1]], _value(tree[2]), _value(tree[3])
        return lambda scope: run(left(scope), right(scope))
    if kind == "filter":
        run, inner = FILTERS[tree[1]], _value(tree[2])
        return lambda scope: run(inner(scope))
    if kind == "not":
        inner = _value(tree[1])
        return lambda scope: not inner(scope)
    left, right = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)

    def get(scope: dict) -> object:
        of, key = left(scope), right(scope)
        if isinstance(of, dict):
            return of.get(key)
        if isinstance(of, (list, str)) and isinstance(key, int):
            return of[key] if -len(of) <= key < len(of) else None
        return None

    return get


class _Output:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _runner(body: list[tuple]) -> Callable[[dict, _Output], None]:
    steps = [_step(node) for node in body]

    def run(scope: dict, out: _Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: tuple) -> Callable[[dict, _Output], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, out: out.write(text)
    if kind == "out":
        value = _value(node[1])
        return lambda scope, out: out.write(_said(value(scope)))
    if kind == "set":
        name, value = node[1], _value(node[2])

        def assign(scope: dict, out: _Output) -> None:
            scope[name] = value(scope)

        return assign
    if kind == "mark":
        inner = _runner(node[1])

        def mark(scope: dict, out: _Output) -> None:
            start = out.length
            inner(scope, out)
            out.spans.append((start, out.length))

        return mark
    if kind == "if":
        branches = [(_value(test), _runner(body)) for test, body in node[1]]

        def choose(scope: dict, out: _Output) -> None:
            for test, inner in branches:
                if test(scope):
                    return inner(scope, out)

        return choose
    name, values, inner = node[1], _value(node[2]), _runner(node[3])

    def each(scope: dict, out: _Output) -> None:
        items = list(values(scope) or ())
        own = dict(scope)
        for i, item in enumerate(items):
            own[name], own["loop"] = item, {"index0": i, "first": i == 0, "last": i == len(items) - 1}
            inner(own, out)

    return each


def compile_template(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """messages -> (text, spans of the generation markers in code points)."""
    run = _runner(fold_body(parse(template)))

    def render(messages: list[dict], **variables: object) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        run({"messages": messages, **variables}, out)
        return "".join(out.parts), out.spans

    return render


def formatted(conversations: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: its id, formatted, loss (array of start, end: the loss mask)."""
    rows = pick(conversations, conv_id, turn, role, text)
    kind = rows.schema[conv_id].dataType
    schema = T.StructType([
        T.StructField(conv_id, kind),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    out_loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def render_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        own, messages, done, size = None, [], [], 0
        id_type = None

        def finish() -> None:
            nonlocal size
            said, spans = render(messages)
            size += len(said)
            done.append((own, said, [{"start": a, "end": b} for a, b in spans]))

        def sent() -> pa.RecordBatch:
            nonlocal size
            ids, texts, spans = zip(*done)
            done.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(texts, pa.string()), pa.array(spans, out_loss)], [conv_id, "formatted", "loss"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if messages and i != own:
                    finish()
                    messages = []
                    if size > 8 << 20:
                        yield sent()
                own = i
                messages.append({"role": r or "", "text": t or ""})
        if messages:
            finish()
        if done:
            yield sent()

    return rows.repartition(conv_id).sortWithinPartitions(conv_id, turn, role, text).mapInArrow(render_all, schema)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text formatted by TEMPLATE."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


_READ = T.StructType([T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("loss", T.StringType())])


@F.arrow_udf(_READ)
def _read(texts: pa.Array, loss: pa.Array) -> pa.Array:
    out = []
    for text, spans in zip(texts.to_pylist(), loss.to_pylist()):
        turns = [{"role": r, "text": t} for r, t in read_back(text)]
        out.append({"turns": turns, "loss": "".join(unescape(text[s["start"] : s["end"]]) for s in spans)})
    return pa.array(out, pa.struct([("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss", pa.string())]))


def parsed(text: Column, loss: Column) -> Column:
    """struct(turns, loss): the turns of a formatted conversation and what lies under its loss mask, unescaped."""
    return _read(text, loss)
