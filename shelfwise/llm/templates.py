"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                     output
    {% for x in messages %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   text that carries loss

An expression is a literal, a name, ``a.b`` on mappings, ``loop.first``,
``loop.index0``, ``==``, ``!=``, ``and``, ``or``, ``not``, ``+``, parentheses, or a
value piped through a filter (``| escape``). There are no calls, attributes,
subscripts or imports, so a template can reach nothing but its inputs.

``parse`` gives a syntax tree, ``fold`` evaluates its constant parts, ``compiled``
returns a generator function of (text, in generation) pieces: a conversation of any
length is rendered turn by turn, without holding it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
TOKENS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|(==|!=|[|+().])|([A-Za-z_]\w*))""")


class TemplateError(ValueError):
    pass


# --- parsing: nodes are tuples whose first item is their kind --------------------


class _Expression:
    def __init__(self, source: str):
        self.items, pos, source = [], 0, source.rstrip()
        while pos < len(source):
            m = TOKENS.match(source, pos)
            if not m:
                raise TemplateError(f"unexpected {source[pos:pos + 10]!r}")
            kind = m.lastindex
            value = m[kind]
            if kind == 1:
                value = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), value[1:-1], flags=re.S)
            self.items.append((kind, int(value) if kind == 2 else value))
            pos = m.end()
        self.i = 0

    def peek(self, *values) -> bool:
        return self.i < len(self.items) and self.items[self.i][0] > 2 and self.items[self.i][1] in values

    def take(self):
        if self.i >= len(self.items):
            raise TemplateError("the expression ends too early")
        self.i += 1
        return self.items[self.i - 1]

    def chain(self, below: Callable, *ops: str):
        left = below()
        while self.peek(*ops):
            op = self.take()[1]
            left = ("binary", op, left, below())
        return left

    def parsed(self):
        node = self.either()
        if self.i < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.i][1]!r}")
        return node

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self.chain(self.joined, "==", "!=")

    def joined(self):
        return self.chain(self.piped, "+")

    def piped(self):
        node = self.primary()
        while self.peek("|"):
            self.take()
            kind, name = self.take()
            if kind != 4:
                raise TemplateError("a filter's name is expected")
            node = ("filter", name, node)
        return node

    def primary(self):
        kind, value = self.take()
        if kind in (1, 2):
            return ("const", value)
        if value == "(":
            node = self.either()
            if self.take()[1] != ")":
                raise TemplateError("a parenthesis is open")
            return node
        if kind != 4 or value in ("and", "or", "not"):
            raise TemplateError(f"unexpected {value!r}")
        node = ("name", value)
        while self.peek("."):
            self.take()
            kind, key = self.take()
            if kind != 4 or key.startswith("_"):
                raise TemplateError("a key is expected")
            node = ("get", node, key)
        return node


def expression(source: str):
    return _Expression(source).parsed()


def parse(source: str) -> tuple:
    parts, pos = TAGS.split(source), 0

    def block(*ends: str):
        nonlocal pos
        nodes = []
        while pos < len(parts):
            part = parts[pos]
            pos += 1
            if part.startswith("{{"):
                nodes.append(("out", expression(part[2:-2])))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return ("block", nodes), word, rest
                nodes.append(statement(word, rest))
            elif part:
                nodes.append(("out", ("const", part)))
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return ("block", nodes), None, None

    def statement(word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest)
            if not m:
                raise TemplateError("for NAME in EXPRESSION is expected")
            return ("for", m[1], expression(m[2]), block("endfor")[0])
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        if word == "if":
            body, end, more = block("elif", "else", "endif")
            if end == "elif":
                other = ("block", [statement("if", more)])
            else:
                other = block("endif")[0] if end == "else" else ("block", [])
            return ("if", expression(rest), body, other)
        raise TemplateError(f"unknown statement {word!r}")

    return block()[0]


# --- constant folding ------------------------------------------------------------


def _binary(op: str, a, b):
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    return ("" if a is None else a) + ("" if b is None else b)


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with constant expressions evaluated, dead branches gone, neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        nodes: list[tuple] = []
        for n in (fold(x, filters) for x in node[1]):
            for n in n[1] if n[0] == "block" else [n]:
                if n == ("out", ("const", "")):
                    continue
                if nodes and n[0] == "out" == nodes[-1][0] and n[1][0] == "const" == nodes[-1][1][0]:
                    nodes[-1] = ("out", ("const", str(nodes[-1][1][1]) + str(n[1][1])))
                else:
                    nodes.append(n)
        return ("block", nodes)
    node = tuple(fold(x, filters) if isinstance(x, tuple) else x for x in node)
    constant = [x[1] for x in node if isinstance(x, tuple) and x[0] == "const"]
    parts = [x for x in node if isinstance(x, tuple)]
    if kind == "if":
        test = node[1]
        return node if test[0] != "const" else node[2] if test[1] else node[3]
    if len(constant) < len(parts) or kind in ("out", "for", "generation"):
        return node
    if kind == "not":
        return ("const", not constant[0])
    if kind == "filter":
        return ("const", filters[node[1]](constant[0]))
    if kind == "binary" and node[1] not in ("and", "or"):
        return ("const", _binary(node[1], *constant))
    return node


# --- closures --------------------------------------------------------------------


def _value(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, k=node[1]: env.get(k)
    if kind == "get":
        owner, key = _value(node[1], filters), node[2]

        def get(env):
            o = owner(env)
            return o.get(key) if isinstance(o, dict) else None

        return get
    if kind == "not":
        inner = _value(node[1], filters)
        return lambda env: not inner(env)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        fn, inner = filters[node[1]], _value(node[2], filters)
        return lambda env: fn(inner(env))
    _, op, left, right = node
    a, b = _value(left, filters), _value(right, filters)
    if op == "and":
        return lambda env: a(env) and b(env)
    if op == "or":
        return lambda env: a(env) or b(env)
    return lambda env: _binary(op, a(env), b(env))


def _render(node: tuple, filters: dict[str, Callable], loss: bool = False) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    kind = node[0]
    if kind == "out":
        value = _value(node[1], filters)

        def out(env):
            v = value(env)
            if v is not None and v != "":
                yield str(v), loss

        return out
    if kind == "generation":
        return _render(node[1], filters, True)
    if kind == "block":
        steps = [_render(n, filters, loss) for n in node[1]]

        def block(env):
            for s in steps:
                yield from s(env)

        return block
    if kind == "if":
        test, yes, no = _value(node[1], filters), _render(node[2], filters, loss), _render(node[3], filters, loss)
        return lambda env: (yes if test(env) else no)(env)
    _, name, source, body = node
    items, inner = _value(source, filters), _render(body, filters, loss)

    def loop(env):
        for i, item in enumerate(items(env) or ()):
            yield from inner({**env, name: item, "loop": {"first": i == 0, "index0": i}})

    return loop


def compiled(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterable[tuple[str, bool]]]:
    """``render(**names)``: the pieces of the output and whether each carries loss."""
    filters = filters or {}
    render = _render(fold(parse(source), filters), filters)
    return lambda **names: render(names)
