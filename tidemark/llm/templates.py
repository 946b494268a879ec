"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}   {% for x in e %} {% endfor %}
    {% generation %} {% endgeneration %}   {# comment #}

Expressions know strings, whole numbers, ``true false none``, names, ``a.b`` and ``a['b']`` (mapping
look-ups only), ``== != < <= > >= in and or not``, ``+``, ``~`` (joins as text), brackets and
``value | filter``.  There are no calls and no access to Python attributes; filters are those handed to
``compile_template``.  The text is parsed into a tree, constant parts of the tree are folded, and the rest
becomes closures that take an environment and yield pieces of text, each with a flag that says whether it
stands between generation marks.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>\d+)|(?P<name>[A-Za-z]\w*)|(?P<sign>==|!=|<=|>=|[-+~|().\[\]<>]))""")
_UNESCAPE = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
            "in": lambda a, b: a in b}
_CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Constant:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """A pure function over argument nodes."""

    function: Callable
    arguments: tuple


@dataclass(frozen=True)
class Choice:
    """``first and second`` or ``first or second``, with the second evaluated only where needed."""

    both: bool
    first: Any
    second: Any


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class If:
    condition: Any
    body: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    values: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def as_text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _look_up(container: Any, key: Any) -> Any:
    if isinstance(container, Mapping):
        return container.get(key)
    raise TemplateError(f"only mappings can be looked into, not {type(container).__name__}")


@dataclass
class _Expression:
    """Recursive-descent parser of one expression."""

    text: str
    filters: Mapping[str, Callable]
    tokens: list = field(default_factory=list)
    at: int = 0

    def __post_init__(self):
        place, text = 0, self.text.rstrip()
        while place < len(text):
            found = _TOKEN.match(text, place)
            if not found:
                raise TemplateError(f"cannot read {text[place:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            place = found.end()

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "string" else value

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing in {self.text!r}")

    def whole(self):
        out = self.any_of()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much in {self.text!r}")
        return out

    def any_of(self):
        left = self.all_of()
        while self.take("or"):
            left = Choice(False, left, self.all_of())
        return left

    def all_of(self):
        left = self.negated()
        while self.take("and"):
            left = Choice(True, left, self.negated())
        return left

    def negated(self):
        return Apply(operator.not_, (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while sign := self.take(*_COMPARE):
            left = Apply(_COMPARE[sign], (left, self.joined()))
        return left

    def joined(self):
        left = self.filtered()
        while sign := self.take("+", "~"):
            right = self.filtered()
            left = Apply(operator.add if sign == "+" else lambda a, b: as_text(a) + as_text(b), (left, right))
        return left

    def filtered(self):
        value = self.primary()
        while self.take("|"):
            name = self.word()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            value = Apply(self.filters[name], (value,))
        return value

    def word(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name":
            raise TemplateError(f"a name is missing in {self.text!r}")
        self.at += 1
        return value

    def primary(self):
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind is None:
            raise TemplateError(f"{self.text!r} ends too early")
        self.at += 1
        if kind == "string":
            return Constant(re.sub(r"\\(.)", lambda m: _UNESCAPE.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Constant(int(value))
        if kind == "name":
            out = Constant(_CONSTANTS[value]) if value in _CONSTANTS else Name(value)
        elif value == "(":
            out = self.any_of()
            self.need(")")
        else:
            raise TemplateError(f"{value!r} does not start a value in {self.text!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                out = Apply(_look_up, (out, Constant(self.word())))
            else:
                out = Apply(_look_up, (out, self.any_of()))
                self.need("]")
        return out


def parse(template: str, filters: Mapping[str, Callable]) -> tuple:
    """The syntax tree: a tuple of statements."""
    parts = [p for p in _PARTS.split(template) if p and not p.startswith("{#")]
    at = 0

    def value(text: str):
        return _Expression(text, filters).whole()

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Output(value(part[2:-2])))
            elif not part.startswith("{%"):
                out.append(Output(Constant(part)))
            else:
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(out), part[2:-2].strip()
                if word == "if":
                    out.append(branch(rest))
                elif word == "for":
                    found = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)
                    if not found:
                        raise TemplateError(f"cannot read {part!r}")
                    out.append(For(found[1], value(found[2]), block("endfor")[0]))
                elif word == "generation":
                    out.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"{part!r} is not expected here")
        if ends:
            raise TemplateError(f"one of {ends} is missing")
        return tuple(out), ""

    def branch(condition: str) -> If:
        body, end = block("elif", "else", "endif")
        other: tuple = ()
        if end.startswith("elif"):
            other = (branch(end[4:]),)
        elif end == "else":
            other = block("endif")[0]
        return If(value(condition), body, other)

    return block()[0]


def fold(node: Any) -> Any:
    """An equal tree with constant expressions evaluated, dead branches gone and neighbouring texts joined."""
    match node:
        case Apply(function, arguments):
            arguments = tuple(fold(a) for a in arguments)
            if all(isinstance(a, Constant) for a in arguments):
                return Constant(function(*(a.value for a in arguments)))
            return Apply(function, arguments)
        case Choice(both, first, second):
            first, second = fold(first), fold(second)
            if isinstance(first, Constant):
                return second if bool(first.value) == both else first
            return Choice(both, first, second)
        case Output(value):
            return Output(fold(value))
        case If(condition, body, other):
            condition = fold(condition)
            if isinstance(condition, Constant):
                return fold(body if condition.value else other)
            return If(condition, fold(body), fold(other))
        case For(name, values, body):
            return For(name, fold(values), fold(body))
        case Generation(body):
            return Generation(fold(body))
        case tuple():
            out: list = []
            for part in node:
                done = fold(part)
                for one in done if isinstance(done, tuple) else (done,):
                    if isinstance(one, Output) and isinstance(one.value, Constant):
                        text = as_text(one.value.value)
                        if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Constant):
                            out[-1] = Output(Constant(out[-1].value.value + text))
                            continue
                        one = Output(Constant(text))
                    out.append(one)
            return tuple(out)
    return node


def _evaluate(node: Any) -> Callable[[dict], Any]:
    match node:
        case Constant(value):
            return lambda env: value
        case Name(name):
            return lambda env: env.get(name)
        case Apply(function, (one,)):
            first = _evaluate(one)
            return lambda env: function(first(env))
        case Apply(function, (one, Constant(fixed))):
            first = _evaluate(one)
            return lambda env: function(first(env), fixed)
        case Apply(function, arguments):
            values = [_evaluate(a) for a in arguments]
            return lambda env: function(*[v(env) for v in values])
        case Choice(both, first, second):
            one, two = _evaluate(first), _evaluate(second)
            return (lambda env: one(env) and two(env)) if both else (lambda env: one(env) or two(env))
    raise TemplateError(f"no value: {node!r}")


def _run(node: Any, generated: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    match node:
        case Output(Constant(text)):
            piece = (text, generated)
            return lambda env: (piece,)
        case Output(value):
            get = _evaluate(value)
            return lambda env: ((as_text(get(env)), generated),)
        case If(condition, body, other):
            test, yes, no = _evaluate(condition), _run(body, generated), _run(other, generated)
            return lambda env: yes(env) if test(env) else no(env)
        case For(name, values, body):
            many, each = _evaluate(values), _run(body, generated)

            def loop(env):
                for value in many(env):  # may be an iterator that is fed while it is read
                    yield from each({**env, name: value})

            return loop
        case Generation(body):
            return _run(body, True)
        case tuple():
            steps = [_run(n, generated) for n in node]
            if len(steps) == 1:
                return steps[0]

            def all_steps(env):
                for step in steps:
                    yield from step(env)

            return all_steps
    raise TemplateError(f"no statement: {node!r}")


def compile_template(template: str, filters: Mapping[str, Callable] | None = None) -> Callable[[Iterable], Iterator[tuple[str, bool]]]:
    """``render(messages)``: yields (text, generated) piece by piece while it reads ``messages``."""
    run = _run(fold(parse(template, filters or {})), False)
    return lambda messages: iter(run({"messages": messages}))
