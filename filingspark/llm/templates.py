"""A compiler for a small, sandboxed template language for conversations.

    text  {{ expression }}  {% for x in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}

Expressions: strings, whole numbers, names and their fields, ``+ == != and or not``, parentheses, and filters
(``x | escape``). Names are looked up in dictionaries only; there are no calls and no attributes, so a template can
reach nothing but what it is given. The syntax tree is folded (constant expressions, joined texts, decided branches)
and becomes Python closures that write text and mark what the model is to generate.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

_PARTS = re.compile(r"({{.*?}}|{%.*?%})", re.S)
_TOKENS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|.()]))""")
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKENS.match(source, at)
        if m is None:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        text, number, name, sign = m.groups()
        if text is not None:
            out.append(("constant", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
        elif number is not None:
            out.append(("constant", int(number)))
        else:
            out.append(("name" if name else "sign", name or sign))
        at = m.end()
    return [*out, ("end", None)]


class _Expressions:
    """or < and < not < == != < + < | filter."""

    def __init__(self, source: str, filters: dict):
        self.todo, self.filters = _tokens(source), filters

    def take(self, *wanted) -> bool:
        if self.todo[0][0] in ("name", "sign") and self.todo[0][1] in wanted:
            self.todo.pop(0)
            return True
        return False

    def whole(self) -> tuple:
        out = self.either()
        if self.todo[0][0] != "end":
            raise TemplateError(f"unexpected {self.todo[0][1]!r}")
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        out = self.added()
        while self.todo[0] in (("sign", "=="), ("sign", "!=")):
            out = (self.todo.pop(0)[1], out, self.added())
        return out

    def added(self) -> tuple:
        out = self.filtered()
        while self.take("+"):
            out = ("+", out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.single()
        while self.take("|"):
            kind, name = self.todo.pop(0)
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            out = ("filter", name, out)
        return out

    def single(self) -> tuple:
        kind, value = self.todo.pop(0)
        if kind == "constant":
            return ("constant", value)
        if (kind, value) == ("sign", "("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("expected )")
            return out
        if kind == "name" and value not in ("and", "or", "not", "in"):
            out = ("name", value)
            while self.take("."):
                kind, value = self.todo.pop(0)
                if kind != "name":
                    raise TemplateError("expected a field")
                out = ("field", out, value)
            return out
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: dict) -> list[tuple]:
    """The syntax tree: ("text", s), ("write", e), ("for", name, e, body), ("if", [(e, body), ...]), ("generation", body)."""
    parts = [p for p in _PARTS.split(source) if p]
    expression = lambda s: _Expressions(s, filters).whole()

    def body(*ends: str) -> tuple[list[tuple], str]:
        out = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                out.append(("write", expression(part[2:-2])))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, f"{word} {rest}"
                if word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                    out.append(("for", m[1], expression(m[2]), body("endfor")[0]))
                elif word == "generation":
                    out.append(("generation", body("endgeneration")[0]))
                elif word == "if":
                    branches, test = [], expression(rest)
                    while True:
                        inner, end = body("elif", "else", "endif")
                        branches.append((test, inner))
                        if end.startswith("endif"):
                            break
                        test = expression(end[4:]) if end.startswith("elif") else ("constant", True)
                    out.append(("if", branches))
                else:
                    raise TemplateError(f"unexpected {part!r}")
            else:
                out.append(("text", part))
        if ends:
            raise TemplateError(f"expected {ends[-1]}")
        return out, ""

    return body()[0]


def _fold_expression(e: tuple, filters: dict) -> tuple:
    if e[0] in ("constant", "name"):
        return e
    inner = tuple(_fold_expression(x, filters) if isinstance(x, tuple) else x for x in e)
    operands = [x for x in inner[1:] if isinstance(x, tuple)]
    if e[0] != "field" and all(x[0] == "constant" for x in operands):
        return ("constant", _expression(inner, filters)({}))
    return inner


def fold(tree: list[tuple], filters: dict) -> list[tuple]:
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in tree:
        if node[0] == "write":
            e = _fold_expression(node[1], filters)
            add(("text", _as_text(e[1])) if e[0] == "constant" else ("write", e))
        elif node[0] == "for":
            inner = fold(node[3], filters)
            if inner:
                add(("for", node[1], _fold_expression(node[2], filters), inner))
        elif node[0] == "generation":
            add(("generation", fold(node[1], filters)))
        elif node[0] == "if":
            branches = []
            for test, inner in node[1]:
                test = _fold_expression(test, filters)
                if test[0] == "constant" and not test[1]:
                    continue
                branches.append((test, fold(inner, filters)))
                if test[0] == "constant":
                    break
            if branches and branches[0][0][0] == "constant":
                for x in branches[0][1]:
                    add(x)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


def _as_text(value: Any) -> str:
    return "" if value is None else str(value)


def _expression(e: tuple, filters: dict) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "constant":
        value = e[1]
        return lambda names: value
    if kind == "name":
        name = e[1]
        return lambda names: names.get(name)
    if kind == "field":
        of, field = _expression(e[1], filters), e[2]
        return lambda names: x.get(field) if isinstance(x := of(names), dict) else None
    if kind == "filter":
        apply, of = filters[e[1]], _expression(e[2], filters)
        return lambda names: apply(_as_text(of(names)))
    if kind == "not":
        of = _expression(e[1], filters)
        return lambda names: not of(names)
    a, b = _expression(e[1], filters), _expression(e[2], filters)
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    if kind == "==":
        return lambda names: a(names) == b(names)
    if kind == "!=":
        return lambda names: a(names) != b(names)

    def added(names):
        x, y = a(names), b(names)
        return x + y if isinstance(x, int) and isinstance(y, int) else _as_text(x) + _as_text(y)

    return added


def _statements(tree: list[tuple], filters: dict) -> Callable[[dict, Callable, bool], None]:
    steps = []
    for node in tree:
        if node[0] == "text":
            steps.append(lambda names, write, mine, text=node[1]: write(text, mine))
        elif node[0] == "write":
            steps.append(lambda names, write, mine, e=_expression(node[1], filters): write(_as_text(e(names)), mine))
        elif node[0] == "generation":
            steps.append(lambda names, write, mine, inner=_statements(node[1], filters): inner(names, write, True))
        elif node[0] == "if":
            branches = [(_expression(test, filters), _statements(inner, filters)) for test, inner in node[1]]

            def choose(names, write, mine, branches=branches):
                for test, inner in branches:
                    if test(names):
                        return inner(names, write, mine)

            steps.append(choose)
        else:

            def loop(names, write, mine, name=node[1], of=_expression(node[2], filters), inner=_statements(node[3], filters)):
                items = list(of(names) or [])
                for i, item in enumerate(items):
                    inner({**names, name: item, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, write, mine)

            steps.append(loop)

    def run(names, write, mine):
        for step in steps:
            step(names, write, mine)

    return run


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from the template's names to (text, spans): the code points, end exclusive, under generation marks; touching spans of one mark are one."""
    program = _statements(fold(parse(source, filters), filters), filters)

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def write(text: str, mine: bool) -> None:
            nonlocal at
            if text:
                out.append(text)
                if mine:
                    if spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], at + len(text))
                    else:
                        spans.append((at, at + len(text)))
                at += len(text)

        program(names, write, False)
        return "".join(out), spans

    return render
