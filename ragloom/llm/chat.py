"""Chat templates, compiled to closures.

The language is a small sandbox that common public chat templates are written in: ``{{ expression }}``, ``{% set name = expression %}``
(also ``name.field`` of a namespace), ``{% if %} / {% elif %} / {% else %} / {% endif %}``, ``{% for name in expression %}``, also
``for key, value in``, with an ``if`` behind it and ``{% else %}`` for nothing (``loop.index``, ``index0``, ``revindex``, ``first``,
``last``, ``length``, ``previtem``, ``nextitem``), ``{% macro name(parameters) %}``, ``{% raw %}``, ``{% generation %} / {% endgeneration %}``
around what a model is to learn, and ``{# comments #}``; a ``-`` inside a tag strips the white space beside it. Names that a loop
or a macro sets end with its round; a namespace outlives it. Expressions have strings, numbers, lists, dicts, names, ``.name``,
``[index]`` and ``[from:to:step]``, ``== != < <= > >= in not and or + - * / // % ~``, conditional expressions, tests (``is defined``,
``is not none``...), the filters in ``FILTERS``, the methods of strings and dicts in ``METHODS``, and the functions ``namespace``,
``range``, ``dict``, ``raise_exception`` and macros. Nothing else can be called and no attribute of a Python object is in reach,
so a template reaches nothing but the data it is given; ranges and repeated strings are limited to ``MOST`` items.

A template is parsed to a syntax tree, constants are folded (also whole branches and neighbouring texts), and each
node becomes one closure.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.shared import table

TEMPLATE = (
    "{% for message in messages %}<|im_start|>{{ message.role }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text }}<|im_end|>{% endgeneration %}"
    "{% else %}{{ message.text }}<|im_end|>{% endif %}\n{% endfor %}"
)


#: Most items of a range, and signs of a repeated string.
MOST = 1_000_000


class TemplateError(ValueError):
    """A template that can't be parsed, or data that it can't render."""


# == syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Listing:
    items: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any
    arguments: tuple
    named: tuple = ()


@dataclass(frozen=True)
class Slice:
    of: Any
    start: Any
    stop: Any
    step: Any


@dataclass(frozen=True)
class Mapping:
    items: tuple


@dataclass(frozen=True)
class Test:
    name: str
    of: Any
    arguments: tuple


@dataclass(frozen=True)
class Method:
    name: str
    of: Any
    arguments: tuple


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple
    named: tuple


@dataclass(frozen=True)
class Emit:
    of: Any


@dataclass(frozen=True)
class Assign:
    name: str
    field: str | None
    of: Any


@dataclass(frozen=True)
class Branch:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    names: tuple
    over: Any
    test: Any
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Macro:
    name: str
    parameters: tuple
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# == parsing

_RAW = re.compile(r"\{%-?\s*raw\s*(-?)%\}(.*?)\{%(-?)\s*endraw\s*-?%\}", re.S)
_TAGS = re.compile(r"(\{%-?\s*raw\s*-?%\}.*?\{%-?\s*endraw\s*-?%\}|\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<float>\d+\.\d+)|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[<>+\-*/%~|.,:(){}\[\]=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", "if", "else", "is"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str, macros: set[str] = frozenset()):
        self.macros = macros
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(source.rstrip())
        while at < end:
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *values: str) -> str | None:
        if (value := self.peek()) in values and value is not None:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at][1] not in _RESERVED:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name was expected")

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> Any:
        found = self.choice()
        self.done()
        return found

    def choice(self) -> Any:
        then = self.either()
        if self.take("if"):
            test = self.either()
            return Choice(test, then, self.choice() if self.take("else") else Const(""))
        return then

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Binary("or", left, self.both())
        return left

    def both(self) -> Any:
        left = self.negation()
        while self.take("and"):
            left = Binary("and", left, self.negation())
        return left

    def negation(self) -> Any:
        return Unary("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        left = self.sum()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                left = Binary(op, left, self.sum())
            elif self.peek() == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                left = Unary("not", Binary("in", left, self.sum()))
            elif self.take("is"):
                negated, name, arguments = self.take("not"), self.word(), ()
                if name not in TESTS:
                    raise TemplateError(f"no test {name!r}")
                if self.take("("):
                    arguments, _ = self.arguments()
                elif name in _TESTS_OF_ONE:
                    arguments = (self.sum(),)
                left = Test(name, left, arguments)
                left = Unary("not", left) if negated else left
            else:
                return left

    def sum(self) -> Any:
        left = self.product()
        while op := self.take("+", "-", "~"):
            left = Binary(op, left, self.product())
        return left

    def product(self) -> Any:
        left = self.sign()
        while op := self.take("*", "/", "//", "%"):
            left = Binary(op, left, self.sign())
        return left

    def sign(self) -> Any:
        return Unary("-", self.sign()) if self.take("-") else self.filtered()

    def filtered(self) -> Any:
        found = self.postfix()
        while self.take("|"):
            name, arguments = self.name(), ((), ())
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                arguments = self.arguments()
                if unknown := [n for n, _ in arguments[1] if n not in FILTERS[name].__code__.co_varnames[1:]]:
                    raise TemplateError(f"filter {name} has no argument {unknown[0]!r}")
            found = Filter(name, found, *arguments)
        return found

    def arguments(self) -> tuple[tuple, tuple]:
        """What is between parentheses of which the first is taken: arguments by place and by name."""
        placed, named = [], []
        while not self.take(")"):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("op", "="):
                name = self.name()
                self.need("=")
                named.append((name, self.choice()))
            elif named:
                raise TemplateError("an argument by place after one by name")
            else:
                placed.append(self.choice())
            if not self.take(","):
                self.need(")")
                break
        return tuple(placed), tuple(named)

    def word(self) -> str:
        """A name, or a word that is a constant elsewhere (none, true)."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name was expected")

    def postfix(self) -> Any:
        found = self.atom()
        while True:
            if self.take("."):
                name = self.word()
                if self.take("("):
                    arguments, named = self.arguments()
                    if name not in METHODS or named:
                        raise TemplateError(f"no method {name!r}")
                    found = Method(name, found, arguments)
                else:
                    found = Item(found, Const(name))
            elif self.take("["):
                found = self.subscript(found)
            elif self.peek() == "(" and isinstance(found, Name):
                if found.name not in FUNCTIONS and found.name not in self.macros:
                    raise TemplateError(f"no function {found.name!r}")
                self.take("(")
                found = Call(found.name, *self.arguments())
            else:
                return found

    def subscript(self, of: Any) -> Any:
        parts: list[Any] = [None]
        while not self.take("]"):
            if self.take(":"):
                parts.append(None)
            elif parts[-1] is None:
                parts[-1] = self.choice()
            else:
                raise TemplateError("']' expected")
        if len(parts) == 1 and parts[0] is not None:
            return Item(of, parts[0])
        if len(parts) in (2, 3):
            return Slice(of, *(p or Const(None) for p in (*parts, None)[:3]))
        raise TemplateError("an index was expected")

    def atom(self) -> Any:
        if self.take("("):
            found = self.choice()
            self.need(")")
            return found
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if not self.take(","):
                    self.need("]")
                    break
            return Listing(tuple(items))
        if self.take("{"):
            pairs = []
            while not self.take("}"):
                key = self.choice()
                self.need(":")
                pairs.append((key, self.choice()))
                if not self.take(","):
                    self.need("}")
                    break
            return Mapping(tuple(pairs))
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind in ("int", "float"):
            self.at += 1
            return Const(int(value) if kind == "int" else float(value))
        if kind == "name" and value in _WORDS:
            self.at += 1
            return Const(_WORDS[value])
        return Name(self.name())


def parse(source: str, trim: bool = False) -> tuple:
    """The syntax tree of a template."""
    parts = _TAGS.split(source)
    if trim:  # tags of statements and comments take the line break behind them and the blanks of their line before them
        tags = [i for i in range(1, len(parts), 2) if not parts[i].startswith("{{")]
        for i in tags:
            line = parts[i - 1].rpartition("\n")[2]
            if not line.strip(" \t") and (len(line) < len(parts[i - 1]) or i == 1):
                parts[i - 1] = parts[i - 1][: len(parts[i - 1]) - len(line)]
        for i in tags:
            parts[i + 1] = parts[i + 1].removeprefix("\n")
    for i in range(1, len(parts), 2):  # texts beside tags with a dash
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-" and len(parts[i]) > 5:
            parts[i + 1] = parts[i + 1].lstrip()
    at, macros = 0, set()

    def block(*stops: str) -> tuple[tuple, str, str]:
        nonlocal at
        nodes: list[Any] = []
        while at < len(parts):
            part, tag = parts[at], at % 2
            at += 1
            if not tag:
                if "{%" in part or "{{" in part:
                    raise TemplateError("a tag isn't closed")
                if part:
                    nodes.append(Emit(Const(part)))
            elif part.startswith("{{"):
                nodes.append(Emit(_Expression(part[2:-2].strip("-"), macros).whole()))
            elif raw := _RAW.fullmatch(part):
                text = raw[2].lstrip() if raw[1] else raw[2]
                nodes.append(Emit(Const(text.rstrip() if raw[3] else text)))
            elif part.startswith("{%"):
                body = part[2:-2].strip("-").strip()
                word, _, rest = body.partition(" ")
                if word in stops:
                    return tuple(nodes), word, rest
                nodes.append(statement(word, rest))
        if stops:
            raise TemplateError(f"{stops[-1]} is missing")
        return tuple(nodes), "", ""

    def statement(word: str, rest: str) -> Any:
        e = _Expression(rest, macros)
        if word == "set":
            name = e.name()
            field = e.name() if e.take(".") else None
            e.need("=")
            return Assign(name, field, e.whole())
        if word == "if":
            test = e.whole()
            then, stop, more = block("elif", "else", "endif")
            if stop == "elif":
                return Branch(test, then, (statement("if", more),))
            return Branch(test, then, block("endif")[0] if stop == "else" else ())
        if word == "for":
            names = [e.name()]
            while e.take(","):
                names.append(e.name())
            e.need("in")
            over = e.either()
            test = e.choice() if e.take("if") else None
            e.done()
            body, stop, _ = block("else", "endfor")
            return Loop(tuple(names), over, test, body, block("endfor")[0] if stop == "else" else ())
        if word == "macro":
            name = e.name()
            e.need("(")
            parameters = []
            while not e.take(")"):
                parameters.append((e.name(), e.choice() if e.take("=") else Const(None)))
                if not e.take(","):
                    e.need(")")
                    break
            e.done()
            macros.add(name)
            return Macro(name, tuple(parameters), block("endmacro")[0])
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    return block()[0]


# == meaning


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else "True" if value is True else "False" if value is False else str(value)


class _Space(dict):
    """A namespace: fields that templates set."""


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key) if isinstance(key, (str, int, float, bool, type(None))) else None
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _has(of: Any, key: Any) -> bool:
    if isinstance(of, (list, tuple, str)):
        return isinstance(key, int) and -len(of) <= key < len(of)
    return isinstance(of, dict) and isinstance(key, (str, int)) and key in of


def _slice(of: Any, *bounds: Any) -> Any:
    if isinstance(of, (list, tuple, str)) and all(b is None or isinstance(b, int) for b in bounds) and bounds[2] != 0:
        return of[slice(*bounds)]
    raise TemplateError("a slice of what has none, or with bounds that are no numbers")


def _short(text: str) -> str:
    if len(text) > 64 * MOST:
        raise TemplateError("a text grows too long")
    return text


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, list) and isinstance(b, list) or isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return _short(a + b) if isinstance(a, list) else a + b
    return _short(_text(a) + _text(b))


def _in(a: Any, b: Any) -> bool:
    return _text(a) in b if isinstance(b, str) else a in b if isinstance(b, (list, dict, tuple)) else False


def _whole(a: Any) -> Any:
    if isinstance(a, (int, float)):
        return a
    raise TemplateError(f"{a!r} isn't a number")


def _ordered(op: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    return lambda a, b: op(a, b) if type(a) is type(b) and isinstance(a, (int, float, str)) else False


def _divided(op: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    def run(a: Any, b: Any) -> Any:
        if not _whole(b):
            raise TemplateError("division by zero")
        return op(_whole(a), _whole(b))

    return run


def _range(*bounds: Any) -> list:
    if not 1 <= len(bounds) <= 3 or not all(isinstance(b, int) for b in bounds) or bounds[2:] == (0,) or len(range(*bounds)) > MOST:
        raise TemplateError("a range needs one to three numbers, and not too many items")
    return list(range(*bounds))


def _raise(message: Any = "", *_: Any) -> None:
    raise TemplateError(_text(message))


def _mapped(v: Any, attribute: Any = None) -> list:
    return [_item(x, attribute) for x in _listed(v)]


def _listed(v: Any) -> list:
    return list(v) if isinstance(v, (list, tuple, dict, str)) else []


def _selected(want: bool) -> Callable[..., list]:
    def run(v: Any, attribute: Any, test: Any = "defined", value: Any = None) -> list:
        if test not in ("defined", "none", "equalto", "eq", "==", "ne", "!=", "in"):
            raise TemplateError(f"no test {test!r}")
        tests = {"defined": lambda x: x is not None, "none": lambda x: x is None, "ne": lambda x: x != value, "!=": lambda x: x != value, "in": lambda x: _in(x, value)}
        return [x for x in _listed(v) if tests.get(test, lambda x: x == value)(_item(x, attribute)) == want]

    return run


def _json(v: Any, indent: Any = None, ensure_ascii: Any = False) -> str:
    return json.dumps(v, ensure_ascii=bool(ensure_ascii), indent=indent if isinstance(indent, int) else None)


def _integer(v: Any) -> int:
    try:
        return int(v)
    except (TypeError, ValueError):
        return 0


def _method(kind: type, run: Callable[..., Any]) -> Callable[..., Any]:
    def checked(v: Any, *arguments: Any) -> Any:
        if not isinstance(v, kind):
            raise TemplateError(f"a method of {kind.__name__} on {type(v).__name__}")
        try:
            return run(v, *arguments)
        except (TypeError, ValueError) as wrong:
            raise TemplateError(str(wrong)) from wrong

    return checked


#: The functions that templates may call.
FUNCTIONS: dict[str, Callable[..., Any]] = {"namespace": lambda **fields: _Space(fields), "dict": lambda **fields: dict(fields), "range": _range, "raise_exception": _raise}
#: The methods of strings and of dicts that templates may call.
METHODS: dict[str, Callable[..., Any]] = {
    **{name: _method(str, getattr(str, name)) for name in ("strip", "lstrip", "rstrip", "upper", "lower", "title", "capitalize", "startswith", "endswith", "split", "rsplit", "find")},
    "replace": _method(str, lambda v, a, b, *n: _short(v.replace(a, b, *n))),
    "items": _method(dict, lambda v: [list(i) for i in v.items()]), "keys": _method(dict, lambda v: list(v)), "values": _method(dict, lambda v: list(v.values())), "get": _method(dict, lambda v, k, d=None: v.get(k, d)),
}
#: What ``is`` asks; whether the value is there is told apart from what it is.
TESTS: dict[str, Callable[..., bool]] = {
    "defined": lambda v: True, "undefined": lambda v: False, "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "mapping": lambda v: isinstance(v, dict), "sequence": lambda v: isinstance(v, (list, tuple, str)),
    "iterable": lambda v: isinstance(v, (list, tuple, str, dict)), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool), "true": lambda v: v is True, "false": lambda v: v is False, "even": lambda v: _whole(v) % 2 == 0, "odd": lambda v: _whole(v) % 2 == 1,
    "divisibleby": lambda v, n: _divided(lambda a, b: a % b)(v, n) == 0, "equalto": lambda v, w: v == w, "eq": lambda v, w: v == w, "in": lambda v, w: _in(v, w),
}
_TESTS_OF_ONE = ("divisibleby", "equalto", "eq", "in")


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _ordered(lambda a, b: a < b), "<=": _ordered(lambda a, b: a <= b), ">": _ordered(lambda a, b: a > b), ">=": _ordered(lambda a, b: a >= b),
    "in": _in, "+": _plus, "~": lambda a, b: _short(_text(a) + _text(b)), "-": lambda a, b: _whole(a) - _whole(b), "*": lambda a, b: _whole(a) * _whole(b), "%": _divided(lambda a, b: a % b), "/": _divided(lambda a, b: a / b), "//": _divided(lambda a, b: a // b),
}
FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(v) if isinstance(v, (str, list, dict, tuple)) else 0, "default": lambda v, default_value="", boolean=False: default_value if v is None or boolean and not v else v,
    "first": lambda v: _item(v, 0), "last": lambda v: _item(v, -1), "replace": lambda v, a, b: _text(v).replace(_text(a), _text(b)), "join": lambda v, s="": _text(s).join(map(_text, v if isinstance(v, (list, tuple)) else [v])), "string": lambda v: _text(v),
    "count": lambda v: len(_listed(v)), "list": lambda v: _listed(v), "items": lambda v: [list(i) for i in v.items()] if isinstance(v, dict) else [], "capitalize": lambda v: _text(v).capitalize(), "title": lambda v: _text(v).title(), "int": lambda v: _integer(v),
    "reverse": lambda v: v[::-1] if isinstance(v, str) else _listed(v)[::-1], "tojson": _json, "map": _mapped, "selectattr": _selected(True), "rejectattr": _selected(False),
}


def fold(node: Any) -> Any:
    """The same tree with every constant part computed."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for n in node:
            done = fold(n)
            for one in done if isinstance(done, tuple) else (done,):
                if isinstance(one, Emit) and isinstance(one.of, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].of, Const):
                    out[-1] = Emit(Const(_text(out[-1].of.value) + _text(one.of.value)))
                else:
                    out.append(one)
        return tuple(out)
    if isinstance(node, Item):
        node = Item(fold(node.of), fold(node.key))
        return Const(_item(node.of.value, node.key.value)) if _constant(node.of, node.key) else node
    if isinstance(node, Unary):
        node = Unary(node.op, fold(node.of))
        return Const(_unary(node.op)(node.of.value)) if _constant(node.of) and (node.op == "not" or isinstance(node.of.value, int)) else node
    if isinstance(node, Binary):
        node = Binary(node.op, fold(node.left), fold(node.right))
        if node.op in ("and", "or"):
            if not _constant(node.left):
                return node
            return node.right if bool(node.left.value) == (node.op == "and") else node.left
        if _constant(node.left, node.right):
            try:
                return Const(BINARY[node.op](node.left.value, node.right.value))
            except TemplateError:
                return node  # it fails where it is reached
        return node
    if isinstance(node, Choice):
        node = Choice(fold(node.test), fold(node.then), fold(node.other))
        return (node.then if node.test.value else node.other) if _constant(node.test) else node
    if isinstance(node, Listing):
        items = tuple(fold(i) for i in node.items)
        return Listing(items)
    if isinstance(node, Filter):
        node = Filter(node.name, fold(node.of), tuple(fold(a) for a in node.arguments), tuple((n, fold(a)) for n, a in node.named))
        if _constant(node.of, *node.arguments, *(a for _, a in node.named)):
            try:
                return Const(FILTERS[node.name](node.of.value, *(a.value for a in node.arguments), **{n: a.value for n, a in node.named}))
            except TemplateError:
                return node  # it fails where it is reached
            except TypeError as wrong:
                raise TemplateError(f"filter {node.name}: {wrong}") from wrong
        return node
    if isinstance(node, Slice):
        return Slice(*(fold(x) for x in (node.of, node.start, node.stop, node.step)))
    if isinstance(node, Mapping):
        return Mapping(tuple((fold(k), fold(v)) for k, v in node.items))
    if isinstance(node, Test):
        return Test(node.name, fold(node.of), tuple(fold(a) for a in node.arguments))
    if isinstance(node, Method):
        return Method(node.name, fold(node.of), tuple(fold(a) for a in node.arguments))
    if isinstance(node, Call):
        return Call(node.name, tuple(fold(a) for a in node.arguments), tuple((n, fold(a)) for n, a in node.named))
    if isinstance(node, Emit):
        of = fold(node.of)
        return () if isinstance(of, Const) and _text(of.value) == "" else Emit(of)
    if isinstance(node, Assign):
        return Assign(node.name, node.field, fold(node.of))
    if isinstance(node, Branch):
        test = fold(node.test)
        if _constant(test):
            return fold(node.then if test.value else node.other)
        return Branch(test, fold(node.then), fold(node.other))
    if isinstance(node, Loop):
        return Loop(node.names, fold(node.over), None if node.test is None else fold(node.test), fold(node.body), fold(node.other))
    if isinstance(node, Macro):
        return Macro(node.name, tuple((n, fold(d)) for n, d in node.parameters), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


def _constant(*nodes: Any) -> bool:
    return all(isinstance(n, Const) for n in nodes)


def _unary(op: str) -> Callable[[Any], Any]:
    return (lambda v: not v) if op == "not" else (lambda v: -_whole(v))


# == closures


class _Out:
    """What is rendered, and where generated parts begin and end."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)
        return lambda env: _item(of(env), key(env))
    if isinstance(node, Unary):
        op, of = _unary(node.op), _value(node.of)
        return lambda env: op(of(env))
    if isinstance(node, Binary):
        left, right = _value(node.left), _value(node.right)
        if node.op == "and":
            return lambda env: left(env) and right(env)
        if node.op == "or":
            return lambda env: left(env) or right(env)
        run = BINARY[node.op]
        return lambda env: run(left(env), right(env))
    if isinstance(node, Choice):
        test, then, other = _value(node.test), _value(node.then), _value(node.other)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(node, Listing):
        items = [_value(i) for i in node.items]
        return lambda env: [i(env) for i in items]
    if isinstance(node, Filter):
        run, of, arguments, named = FILTERS[node.name], _value(node.of), [_value(a) for a in node.arguments], [(n, _value(a)) for n, a in node.named]
        return lambda env: _tried(run, of(env), *(a(env) for a in arguments), **{n: a(env) for n, a in named})
    if isinstance(node, Slice):
        of, bounds = _value(node.of), [_value(x) for x in (node.start, node.stop, node.step)]
        return lambda env: _slice(of(env), *(b(env) for b in bounds))
    if isinstance(node, Mapping):
        pairs = [(_value(k), _value(v)) for k, v in node.items]
        return lambda env: {k if isinstance(k := key(env), (str, int)) else _text(k): v(env) for key, v in pairs}
    if isinstance(node, Test):
        run, of, there, arguments = TESTS[node.name], _value(node.of), _there(node.of), [_value(a) for a in node.arguments]
        absent = node.name == "undefined"  # all that is asked of what isn't there is false but this
        return lambda env: _tried(run, of(env), *(a(env) for a in arguments)) if there(env) else absent
    if isinstance(node, Method):
        run, of, arguments = METHODS[node.name], _value(node.of), [_value(a) for a in node.arguments]
        return lambda env: run(of(env), *(a(env) for a in arguments))
    if isinstance(node, Call):
        name, own, arguments, named = node.name, FUNCTIONS.get(node.name), [_value(a) for a in node.arguments], [(n, _value(a)) for n, a in node.named]

        def call(env: dict) -> Any:
            run = own or env.get(name)
            if not own and not isinstance(run, _Callable):
                raise TemplateError(f"no function {name!r}")
            return _tried(run, *(a(env) for a in arguments), **{n: a(env) for n, a in named})

        return call
    raise TemplateError(f"{node!r} isn't an expression")


def _tried(run: Callable[..., Any], *arguments: Any, **named: Any) -> Any:
    try:
        return run(*arguments, **named)
    except TypeError as wrong:
        raise TemplateError(str(wrong)) from wrong


def _there(node: Any) -> Callable[[dict], bool]:
    """Whether the value of an expression is there at all."""
    if isinstance(node, Name):
        name = node.name
        return lambda env: name in env
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)
        return lambda env: _has(of(env), key(env))
    return lambda env: True


class _Callable:
    """A macro: it renders to a text; generation markers in it don't count."""

    def __init__(self, parameters: list, body: Callable[[dict, _Out], None], env: dict):
        self.parameters, self.body, self.env = parameters, body, env

    def __call__(self, *arguments: Any, **named: Any) -> str:
        if len(arguments) > len(self.parameters) or not named.keys() <= {n for n, _ in self.parameters}:
            raise TemplateError("a macro has other parameters")
        inner, out = dict(self.env), _Out()
        inner.update({n: d(inner) for n, d in self.parameters})
        inner.update(zip((n for n, _ in self.parameters), arguments, strict=False))
        inner.update(named)
        self.body(inner, out)
        return "".join(out.parts)


def _action(node: Any) -> Callable[[dict, _Out], None]:
    if isinstance(node, Emit):
        of = _value(node.of)
        if isinstance(node.of, Const):
            text = _text(node.of.value)
            return lambda env, out: out.put(text)
        return lambda env, out: out.put(_text(of(env)))
    if isinstance(node, Assign):
        name, field, value = node.name, node.field, _value(node.of)

        def assign(env: dict, out: _Out) -> None:
            if field is None:
                env[name] = value(env)
            elif isinstance(space := env.get(name), _Space):
                space[field] = value(env)
            else:
                raise TemplateError(f"{name!r} is no namespace")

        return assign
    if isinstance(node, Macro):
        name, parameters, body = node.name, [(n, _value(d)) for n, d in node.parameters], _sequence(node.body)

        def define(env: dict, out: _Out) -> None:
            env[name] = _Callable(parameters, body, env)

        return define
    if isinstance(node, Branch):
        test, then, other = _value(node.test), _sequence(node.then), _sequence(node.other)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    if isinstance(node, Loop):
        names, over, body, other = node.names, _value(node.over), _sequence(node.body), _sequence(node.other)
        test = None if node.test is None else _value(node.test)

        def entered(env: dict, item: Any) -> dict:
            inner = dict(env)  # what a round sets ends with it
            if len(names) == 1:
                inner[names[0]] = item
            elif isinstance(item, (list, tuple)) and len(item) == len(names):
                inner.update(zip(names, item, strict=True))
            else:
                raise TemplateError("an item can't be taken apart")
            return inner

        def loop(env: dict, out: _Out) -> None:
            items = over(env)
            items = list(items) if isinstance(items, (list, tuple, dict, str)) else []
            if test is not None:
                items = [i for i in items if test(entered(env, i))]
            n = len(items)
            for i, item in enumerate(items):
                inner = entered(env, item)
                inner["loop"] = {"index": i + 1, "index0": i, "revindex": n - i, "revindex0": n - i - 1, "first": i == 0, "last": i == n - 1, "length": n}
                if i:
                    inner["loop"]["previtem"] = items[i - 1]
                if i + 1 < n:
                    inner["loop"]["nextitem"] = items[i + 1]
                body(inner, out)
            if not items:
                other(env, out)

        return loop
    if isinstance(node, Generation):
        body = _sequence(node.body)

        def generation(env: dict, out: _Out) -> None:
            begin = out.size
            body(env, out)
            if out.size > begin:
                out.spans.append((begin, out.size))

        return generation
    raise TemplateError(f"{node!r} isn't a statement")


def _sequence(nodes: tuple) -> Callable[[dict, _Out], None]:
    actions = [_action(n) for n in nodes]
    if len(actions) == 1:
        return actions[0]

    def run(env: dict, out: _Out) -> None:
        for a in actions:
            a(env, out)

    return run


def compile_template(source: str, trim: bool = False) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from data to the rendered text and the spans, in characters, that generation markers enclose.

    trim: the line break after a statement goes, and so do the blanks before one that begins a line, as public chat templates expect.
    """
    run = _sequence(fold(parse(source, trim)))

    def render(data: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        try:
            run(dict(data), out)
        except RecursionError as wrong:
            raise TemplateError("macros call each other without an end") from wrong
        return "".join(out.parts), out.spans

    return render


# == operator


def rendered(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, prompt (the rendered text), generated (spans "begin-end" in characters, joined by commas).

    Defined results: turns are in the order of turn, then role, then text, nulls first; a null role or text renders
    as nothing; turns with a null conv_id belong to no conversation and are left out; repeated turns are rendered as
    often as they occur. Texts are rendered whole, whatever their length. Other columns are ignored. A conversation is
    rendered by one task, as a template may look at all its turns.
    """
    compile_template(template)  # a wrong template fails here and not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            texts, spans = [], []
            for messages in batch.column("messages").to_pylist():
                text, marked = render({"messages": messages})
                texts.append(text)
                spans.append(",".join(f"{a}-{b}" for a, b in marked))
            yield pa.record_batch([batch.column("conv_id"), batch.column("n_turns"), pa.array(texts, pa.string()), pa.array(spans, pa.string())], ["conv_id", "n_turns", "prompt", "generated"])

    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("m"))
    grouped = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))
    return grouped.select("conv_id", F.size("messages").cast("long").alias("n_turns"), "messages").mapInArrow(run, "conv_id long, n_turns long, prompt string, generated string")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


SQL = """
with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
parts as (select *, '<|im_start|>' || role || chr(10) as head, text || '<|im_end|>' as body from turns),
sums as (select *, sum(length(head) + length(body) + 1) over (partition by conv_id order by k)::bigint as stop from parts)
select conv_id, count(*) as n_turns, string_agg(head || body || chr(10), '' order by k) as prompt,
    coalesce(string_agg((stop - 1 - length(body))::varchar || '-' || (stop - 1)::varchar, ',' order by k) filter (where role = 'assistant'), '') as generated
from sums group by conv_id
"""
