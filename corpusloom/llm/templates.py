"""A compiler for a small sandboxed template language, made for chat formats.

    text {{ expression }} {% for x in e %}..{% endfor %} {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% set x = e %} {% generation %}..{% endgeneration %} {# comment #}
    A minus beside a brace ({{-, -}}, {%-, -%}, {#-, -#}) trims the white space of the text on that side.

Expressions: strings, integers, true, false, none, names, a.b and a["b"], ==, !=, <, <=, >, >=, in, not, and, or, +, ~, filters (| name) and
parentheses. Attributes are dictionary keys or, by integer, list items only; there are no calls, so that a template reaches nothing but what
it is given. A template is parsed to a syntax tree, constants are folded (literal operations, branches on constants, neighbouring texts) and
each node becomes a Python closure. Rendering emits (text, in generation block) in order and holds no more than one piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

Emit = Callable[[str, bool], None]


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    kind: str
    value: Any = None
    parts: list = field(default_factory=list)


_TOKEN = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.\[\]()]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_PIECE = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_LITERALS = {"true": True, "false": False, "none": None}
_COMPARE: dict[str, Callable[[Any, Any], bool]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}


class _Expression:
    """Recursive descent: or < and < not < comparison < + ~ < filters and access."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:].strip()!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return value if kind in ("op", "name") and value in values else None

    def take(self, *values: str) -> str | None:
        if found := self.peek(*values):
            self.at += 1
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return value

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} unexpected")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", parts=[node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", parts=[node, self.negated()])
        return node

    def negated(self) -> Node:
        return Node("not", parts=[self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.added()
        while op := self.take(*_COMPARE):
            node = Node("compare", op, [node, self.added()])
        return node

    def added(self) -> Node:
        node = self.filtered()
        while op := self.take("+", "~"):
            node = Node("add", op, [node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while op := self.take(".", "[", "|"):
            if op == ".":
                node = Node("item", parts=[node, Node("const", self.name())])
            elif op == "[":
                node = Node("item", parts=[node, self.either()])
                self.need("]")
            else:
                node = Node("filter", self.name(), [node])
        return node

    def atom(self) -> Node:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "int":
            return Node("const", int(value))
        if kind == "str":
            return Node("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return Node("const", _LITERALS[value]) if value in _LITERALS else Node("name", value)
        raise TemplateError("an expression expected")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    root = Node("block")
    stack = [root]
    opened: list[Node] = []
    at, trim = 0, False

    def text_between(lo: int, hi: int, left: bool, right: bool) -> None:
        text = source[lo:hi]
        text = text.lstrip() if left else text
        text = text.rstrip() if right else text
        if text:
            stack[-1].parts.append(Node("text", text))

    for m in _PIECE.finditer(source):
        text_between(at, m.start(), trim, m[0][2] == "-")
        at, trim = m.end(), m[0][-3] == "-"
        if m[1] is not None:
            stack[-1].parts.append(Node("put", parts=[_Expression(m[1]).whole()]))
            continue
        if m[2] is None:
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            opened.append(Node("for", name, [e.whole(), Node("block")]))
        elif word == "if":
            opened.append(Node("if", parts=[_Expression(rest).whole(), Node("block"), Node("block")]))
        elif word == "generation":
            opened.append(Node("generation", parts=[Node("block")]))
        elif word == "set":
            name, _, value = rest.partition("=")
            stack[-1].parts.append(Node("set", name.strip(), [_Expression(value).whole()]))
            continue
        elif word in ("elif", "else"):
            if not opened or opened[-1].kind not in ("if", "elif") or len(stack) < 2 or stack[-1] is not opened[-1].parts[1]:
                raise TemplateError(f"{word} without if")
            stack[-1] = opened[-1].parts[2]
            if word == "elif":
                opened.append(Node("elif", parts=[_Expression(rest).whole(), Node("block"), Node("block")]))
                stack[-1].parts.append(opened[-1])
                stack.append(opened[-1].parts[1])
            continue
        elif word in ("endfor", "endif", "endgeneration"):
            while word == "endif" and opened and opened[-1].kind == "elif":
                opened.pop().kind = "if"
                stack.pop()
            if not opened or opened[-1].kind != word[3:]:
                raise TemplateError(f"{word} without {word[3:]}")
            opened.pop()
            stack.pop()
            continue
        else:
            raise TemplateError(f"unknown tag {word!r}")
        stack[-1].parts.append(opened[-1])
        stack.append(opened[-1].parts[0 if word == "generation" else 1])
    if opened:
        raise TemplateError(f"{opened[-1].kind} is not ended")
    text_between(at, len(source), trim, False)
    return root


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def fold(node: Node, filters: dict[str, Callable[[Any], Any]]) -> Node:
    """The same tree with constant parts computed."""
    parts = [fold(p, filters) for p in node.parts]
    const = bool(parts) and all(p.kind == "const" for p in parts)
    if node.kind in ("add", "compare", "not", "filter", "item") and const:
        return Node("const", _expression(Node(node.kind, node.value, parts), filters)({}))
    if node.kind in ("and", "or") and parts[0].kind == "const":
        return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
    if node.kind == "put" and const:
        return Node("text", _text(parts[0].value))
    if node.kind == "if" and parts[0].kind == "const":
        return parts[1 if parts[0].value else 2]
    if node.kind == "block":
        flat: list[Node] = []
        for p in (q for x in parts for q in (x.parts if x.kind == "block" else [x])):
            if p.kind == "text" and flat and flat[-1].kind == "text":
                flat[-1] = Node("text", flat[-1].value + p.value)
            elif p.kind != "text" or p.value:
                flat.append(p)
        parts = flat
    return Node(node.kind, node.value, parts)


def _expression(node: Node, filters: dict[str, Callable[[Any], Any]]) -> Callable[[dict], Any]:
    value, kind = node.value, node.kind
    if kind == "const":
        return lambda scope: value
    if kind == "name":
        return lambda scope: scope.get(value)
    made = [_expression(p, filters) for p in node.parts]
    a, b = made[0], made[-1]
    if kind == "item":
        return lambda scope: _item(a(scope), b(scope))
    if kind == "filter":
        if value not in filters:
            raise TemplateError(f"unknown filter {value!r}")
        f = filters[value]
        return lambda scope: f(a(scope))
    if kind == "not":
        return lambda scope: not a(scope)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "compare":
        op = _COMPARE[value]
        return lambda scope: op(a(scope), b(scope))

    def add(scope: dict) -> Any:
        x, y = a(scope), b(scope)
        return x + y if value == "+" and isinstance(x, int) and isinstance(y, int) else _text(x) + _text(y)

    return add


def _statement(node: Node, filters: dict[str, Callable[[Any], Any]]) -> Callable[[dict, Emit, bool], None]:
    value = node.value
    if node.kind == "text":
        return lambda scope, emit, masked: emit(value, masked)
    if node.kind == "put":
        e = _expression(node.parts[0], filters)
        return lambda scope, emit, masked: emit(_text(e(scope)), masked)
    if node.kind == "set":
        e = _expression(node.parts[0], filters)
        return lambda scope, emit, masked: scope.__setitem__(value, e(scope))
    if node.kind == "generation":
        inner = _statement(node.parts[0], filters)
        return lambda scope, emit, masked: inner(scope, emit, True)
    if node.kind == "if":
        e, yes, no = _expression(node.parts[0], filters), _statement(node.parts[1], filters), _statement(node.parts[2], filters)
        return lambda scope, emit, masked: (yes if e(scope) else no)(scope, emit, masked)
    if node.kind == "for":
        e, body = _expression(node.parts[0], filters), _statement(node.parts[1], filters)

        def loop(scope: dict, emit: Emit, masked: bool) -> None:
            for x in e(scope) or ():
                body(scope | {value: x}, emit, masked)

        return loop
    made = [_statement(p, filters) for p in node.parts]

    def block(scope: dict, emit: Emit, masked: bool) -> None:
        for run in made:
            run(scope, emit, masked)

    return block


FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: len(x or ()), "string": _text}


class Template:
    def __init__(self, source: str, filters: dict[str, Callable[[Any], Any]] | None = None):
        self.filters = FILTERS | (filters or {})
        self.tree = fold(parse(source), self.filters)
        self._run = _statement(self.tree, self.filters)

    def stream(self, emit: Emit, **scope: Any) -> None:
        self._run(dict(scope), emit, False)

    def render(self, **scope: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text and the code point spans [start, end) that generation blocks made."""
        out: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def emit(text: str, masked: bool) -> None:
            nonlocal at
            if masked and text:
                spans.append((spans.pop()[0], at + len(text)) if spans and spans[-1][1] == at else (at, at + len(text)))
            out.append(text)
            at += len(text)

        self.stream(emit, **scope)
        return "".join(out), spans


def messages(rows: Iterable[tuple[str, str]]) -> Iterable[dict[str, str]]:
    return ({"role": role, "text": text} for role, text in rows)
