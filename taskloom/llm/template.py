"""A small sandboxed template language for conversations, compiled to Python closures.

    {{ expression }}                      puts a value out
    {% for m in messages %}...{% endfor %}    goes through a sequence, also one that is read only once
    {% if e %}...{% elif e %}...{% else %}...{% endif %}
    {% generation %}...{% endgeneration %}    marks what a model is trained to say
    {# comment #}

Expressions: texts in quotes, whole numbers, true, false, none; names; `m.role` and `m["role"]`, which look up keys of mappings
only; `==`, `!=`, `in`, `and`, `or`, `not`, `+` of two texts or two numbers, `~` of any texts; filters `| trim`, `| upper`, `| lower`,
`| title` and those the caller gives. In a loop, `loop.index`, `loop.index0`, `loop.first` and `loop.last`. No call, attribute or
import can be written, so a template reaches nothing but what it is given. A missing name or key is none; none puts out nothing.

Compilation: parse to a tree, compute what doesn't depend on input, drop branches that can't be taken, join adjacent
texts, and turn each node into a closure. Rendering yields (text, marked) pieces one by one, so
memory doesn't grow with the conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from itertools import chain
from typing import Any

TAG = re.compile(r"\{\{(?P<out>.*?)\}\}|\{%(?P<tag>.*?)%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<text>"[^"]*"|'[^']*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[-+~|.()\[\]]))""")
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: shown(v).strip(),
    "upper": lambda v: shown(v).upper(),
    "lower": lambda v: shown(v).lower(),
    "title": lambda v: shown(v).title(),
}
CONSTANTS = {"true": True, "false": False, "none": None}
KEYWORDS = {"and", "or", "not", "in", *CONSTANTS}
Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter on its arguments."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Marked:
    body: tuple


def shown(value: Any) -> str:
    return "" if value is None else {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)


def look_up(value: Any, key: Any) -> Any:
    return value.get(key) if isinstance(value, Mapping) else None


def contains(value: Any, within: Any) -> bool:
    if isinstance(within, str):
        return shown(value) in within
    return isinstance(within, Mapping) and value in within


def add(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ takes two texts or two numbers; ~ joins any")


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": contains,
    "not": lambda a: not a,
    "+": add,
    "~": lambda a, b: shown(a) + shown(b),
    ".": look_up,
}


class Expression:
    """Reads one expression by descent: or, and, not, comparison, sum, filter, key."""

    def __init__(self, source: str, filters: Mapping[str, Callable]) -> None:
        self.source, self.filters, self.at, self.tokens = source, filters, 0, []
        end, source = 0, source.rstrip()
        while end < len(source):
            found = TOKEN.match(source, end)
            if not found:
                raise TemplateError(f"can't read {source[end:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            end = found.end()

    def parse(self) -> Any:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return tree

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def either(self) -> Any:
        tree = self.both()
        while self.take("or"):
            tree = Apply("or", (tree, self.both()))
        return tree

    def both(self) -> Any:
        tree = self.negated()
        while self.take("and"):
            tree = Apply("and", (tree, self.negated()))
        return tree

    def negated(self) -> Any:
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        tree = self.summed()
        while sign := self.take("==", "!=", "in"):
            tree = Apply(sign, (tree, self.summed()))
        return tree

    def summed(self) -> Any:
        tree = self.filtered()
        while sign := self.take("+", "~"):
            tree = Apply(sign, (tree, self.filtered()))
        return tree

    def filtered(self) -> Any:
        tree = self.keyed()
        while self.take("|"):
            name = self.token("name")
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            tree = Apply(f"|{name}", (tree,))
        return tree

    def keyed(self) -> Any:
        tree = self.single()
        while sign := self.take(".", "["):
            tree = Apply(".", (tree, Const(self.token("name")) if sign == "." else self.either()))
            if sign == "[" and not self.take("]"):
                raise TemplateError(f"] is missing in {self.source!r}")
        return tree

    def token(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def single(self) -> Any:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(f") is missing in {self.source!r}")
            return tree
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else "name"
        if kind == "sign":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        text = self.token(kind)
        if kind == "text":
            return Const(text[1:-1])
        if kind == "number":
            return Const(int(text))
        if text in KEYWORDS and text not in CONSTANTS:
            raise TemplateError(f"unexpected {text!r} in {self.source!r}")
        return Const(CONSTANTS[text]) if text in CONSTANTS else Name(text)


def parse(source: str, filters: Mapping[str, Callable]) -> tuple:
    """The tree of a template. After a tag that ends in `-%}` or before one that begins with `{%-`, blanks go."""
    parts: list[tuple[str, str]] = []
    end, strip = 0, False
    for found in TAG.finditer(source):
        text = source[end : found.start()]
        inner = found["out"] if found["out"] is not None else found["tag"] if found["tag"] is not None else ""
        text = text.lstrip() if strip else text
        parts.append(("text", text.rstrip() if inner.startswith("-") else text))
        strip, end = inner.endswith("-"), found.end()
        kind = "out" if found["out"] is not None else "tag" if found["tag"] is not None else ""
        if kind:
            parts.append((kind, inner.strip("-").strip()))
    parts.append(("text", source[end:].lstrip() if strip else source[end:]))
    rest = iter(parts)

    def block(*ends: str) -> tuple[tuple, str]:
        nodes: list = []
        for kind, what in rest:
            if kind == "text":
                if what:
                    nodes.append(Out(Const(what)))
                continue
            if kind == "out":
                nodes.append(Out(Expression(what, filters).parse()))
                continue
            word, _, tail = what.partition(" ")
            if word in ends:
                return tuple(nodes), what
            if word == "if":
                nodes.append(branch(tail))
            elif word == "for":
                if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", tail.strip(), re.S)) or m[1] in KEYWORDS | {"loop"}:
                    raise TemplateError(f"can't read {what!r}")
                nodes.append(For(m[1], Expression(m[2], filters).parse(), block("endfor")[0]))
            elif word == "generation":
                nodes.append(Marked(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {what!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(nodes), ""

    def branch(test: str) -> If:
        then, closer = block("elif", "else", "endif")
        word, _, tail = closer.partition(" ")
        other = (branch(tail),) if word == "elif" else block("endif")[0] if word == "else" else ()
        return If(Expression(test, filters).parse(), then, other)

    return block()[0]


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The tree with all that doesn't depend on input computed; a tuple of nodes stays one."""
    if isinstance(node, tuple):
        nodes: list = []
        for x in chain.from_iterable(y if isinstance(y, tuple) else (y,) for y in (fold(z, filters) for z in node)):
            if isinstance(x, Out) and isinstance(x.value, Const):
                if nodes and isinstance(nodes[-1], Out) and isinstance(nodes[-1].value, Const):
                    x = Out(Const(nodes.pop().value.value + shown(x.value.value)))
                else:
                    x = Out(Const(shown(x.value.value)))
                if not x.value.value:
                    continue
            nodes.append(x)
        return tuple(nodes)
    if isinstance(node, Apply):
        args = tuple(fold(x, filters) for x in node.args)
        if node.op in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        elif all(isinstance(x, Const) for x in args):
            return Const(operation(node.op, filters)(*(x.value for x in args)))
        return Apply(node.op, args)
    if isinstance(node, Out):
        return Out(fold(node.value, filters))
    if isinstance(node, If):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return If(test, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    return Marked(fold(node.body, filters)) if isinstance(node, Marked) else node


def operation(op: str, filters: Mapping[str, Callable]) -> Callable:
    return filters[op[1:]] if op[0] == "|" else OPERATORS[op]


def value_of(node: Any, filters: Mapping[str, Callable]) -> Callable[[Mapping], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    args = [value_of(x, filters) for x in node.args]
    if node.op == "and":
        return lambda env, a=args[0], b=args[1]: a(env) and b(env)
    if node.op == "or":
        return lambda env, a=args[0], b=args[1]: a(env) or b(env)
    run = operation(node.op, filters)
    if len(args) == 1:
        return lambda env, a=args[0]: run(a(env))
    return lambda env, a=args[0], b=args[1]: run(a(env), b(env))


Render = Callable[[Mapping, bool], Iterator[Piece]]


def closure(node: Any, filters: Mapping[str, Callable]) -> Render:
    if isinstance(node, tuple):
        parts = [closure(x, filters) for x in node]

        def sequence(env: Mapping, marked: bool) -> Iterator[Piece]:
            for part in parts:
                yield from part(env, marked)

        return sequence
    if isinstance(node, Out):
        if isinstance(node.value, Const):
            return lambda env, marked, v=node.value.value: iter(((v, marked),))
        value = value_of(node.value, filters)
        return lambda env, marked: iter(((shown(value(env)), marked),))
    if isinstance(node, Marked):
        body = closure(node.body, filters)
        return lambda env, marked: body(env, True)
    if isinstance(node, If):
        test, then, other = value_of(node.test, filters), closure(node.then, filters), closure(node.other, filters)
        return lambda env, marked: (then if test(env) else other)(env, marked)
    over, body = value_of(node.over, filters), closure(node.body, filters)

    def loop(env: Mapping, marked: bool) -> Iterator[Piece]:
        items = over(env)
        if items is None or isinstance(items, (str, Mapping)):
            return
        none = object()
        items = iter(items)
        now, i = next(items, none), 0
        while now is not none:
            after = next(items, none)
            about = {"index": i + 1, "index0": i, "first": i == 0, "last": after is none}
            yield from body({**env, node.name: now, "loop": about}, marked)
            now, i = after, i + 1

    return loop


class Template:
    def __init__(self, source: str, filters: Mapping[str, Callable] = {}) -> None:  # noqa: B006
        self.filters = FILTERS | dict(filters)
        self.tree = fold(parse(source, self.filters), self.filters)
        self.run = closure(self.tree, self.filters)

    def render(self, **env: Any) -> Iterator[Piece]:
        """(text, marked) pieces in order; none is empty."""
        return (x for x in self.run(env, False) if x[0])
