"""A small sandboxed template language for conversations.

    {{ expression }}      output
    {% for message in messages %} ... {% endfor %}
    {% if test %} ... {% elif test %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}   text that the loss is taken on
    {# comment #}, and - inside a delimiter trims the white space beyond it

Expressions: strings, whole numbers, true, false, none, names, fields
(``message.role``, ``loop.first``), ``+ ~ == != < <= > >= in and or not``,
parentheses, and the filters given to ``compile_template``. There are no calls,
no subscripts and no access to attributes of Python objects: a name is looked
up among the values given, a field among the keys of a mapping.

The text is parsed to a syntax tree, constant parts of the tree are folded, and
each node becomes a Python closure. A compiled template is a generator over the
messages, which may be an iterator: it looks one message ahead (for
``loop.last``) and holds no other, so a conversation of any length streams.
"""

from __future__ import annotations

import re

TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().|]))")
PART = re.compile(r"\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\}", re.S)
CONSTANTS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


# --- syntax tree: tuples (kind, ...) ---------------------------------------

class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str, filters):
        self.tokens, self.filters, self.at = [], filters, 0
        end = 0
        while text[end:].strip():
            m = TOKEN.match(text, end)
            if not m:
                raise TemplateError(f"cannot read {text[end:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            end = m.end()

    def parse(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def peek(self, *texts):
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in texts

    def take(self, *texts):
        if self.peek(*texts):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            left = ("op", op, left, self.joined())
        return left

    def joined(self):
        left = self.filtered()
        while op := self.take("+", "~"):
            left = ("op", op, left, self.filtered())
        return left

    def filtered(self):
        tree = self.value()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def name(self):
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def value(self):
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return tree
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return ("constant", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            return ("constant", int(text))
        if kind != "name":
            raise TemplateError(f"unexpected {text!r}")
        if text in CONSTANTS:
            return ("constant", CONSTANTS[text])
        tree = ("name", text)
        while self.take("."):
            tree = ("field", tree, self.name())
        return tree


def parse(source: str, filters=()) -> tuple:
    """Template text -> ("block", nodes)."""
    parts, at = [], 0
    for m in PART.finditer(source):
        parts += [source[at:m.start()], m.group()]
        at = m.end()
    parts.append(source[at:])
    for k in range(1, len(parts), 2):
        if parts[k][2] == "-":
            parts[k - 1] = parts[k - 1].rstrip()
        if parts[k][-3] == "-":
            parts[k + 1] = parts[k + 1].lstrip()
    expression = lambda text: _Expression(text, filters).parse()
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    for k, part in enumerate(parts):
        nodes = stack[-1][1]
        if k % 2 == 0:
            if part:
                nodes.append(("constant", part))
            continue
        body = part[2:-2].strip("-").strip()
        if part[1] == "#":
            continue
        if part[1] == "{":
            nodes.append(expression(body))
            continue
        word, _, rest = body.partition(" ")
        if word == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+messages", rest.strip())
            if not m or any(x[0] == "for" for x in stack):
                raise TemplateError("loops run over messages and do not nest")
            inner: list = []
            nodes.append(("for", m[1], inner))
            stack.append(("for", inner))
        elif word == "if":
            branch: list = []
            cases = [(expression(rest), branch)]
            nodes.append(("if", cases))
            stack.append(("if", branch))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            stack.pop()
            cases, branch = stack[-1][1][-1][1], []
            cases.append((expression(rest) if word == "elif" else ("constant", True), branch))
            stack.append(("if", branch))
        elif word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.*)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"cannot read set {rest!r}")
            nodes.append(("set", m[1], expression(m[2])))
        elif word == "generation":
            inner = []
            nodes.append(("generation", inner))
            stack.append(("generation", inner))
        elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {body!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return ("block", root)


OPS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "~": lambda a, b: text_of(a) + text_of(b),
}


def text_of(value) -> str:
    return "" if value is None else value if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else str(value)


def fold(node: tuple, filters) -> tuple:
    """The tree with constant parts evaluated, dead branches dropped and
    neighbouring constant output joined."""
    kind = node[0]
    if kind in ("block", "generation"):
        return (kind, _fold_all(node[1], filters))
    if kind == "for":
        return (kind, node[1], _fold_all(node[2], filters))
    if kind == "if":
        cases = []
        for test, body in node[1]:
            test = fold(test, filters)
            if test[0] == "constant" and not test[1]:
                continue
            cases.append((test, _fold_all(body, filters)))
            if test[0] == "constant":
                break
        return ("block", cases[0][1]) if cases and cases[0][0][0] == "constant" else ("if", cases) if cases else ("block", [])
    if kind == "set":
        return (kind, node[1], fold(node[2], filters))
    if kind == "op":
        a, b = fold(node[2], filters), fold(node[3], filters)
        return ("constant", OPS[node[1]](a[1], b[1])) if a[0] == b[0] == "constant" else (kind, node[1], a, b)
    if kind in ("and", "or"):
        a, b = fold(node[1], filters), fold(node[2], filters)
        if a[0] == "constant":
            return (b if a[1] else a) if kind == "and" else (a if a[1] else b)
        return (kind, a, b)
    if kind == "not":
        a = fold(node[1], filters)
        return ("constant", not a[1]) if a[0] == "constant" else (kind, a)
    if kind == "filter":
        a = fold(node[2], filters)
        return ("constant", filters[node[1]](a[1])) if a[0] == "constant" else (kind, node[1], a)
    return node


def _fold_all(nodes: list, filters) -> list:
    out: list = []
    for node in nodes:
        node = fold(node, filters)
        if node[0] == "constant":
            text = text_of(node[1])
            if out and out[-1][0] == "constant":
                out[-1] = ("constant", out[-1][1] + text)
            elif text:
                out.append(("constant", text))
        else:
            out.extend(node[1] if node[0] == "block" else [node])
    return out


# --- closures ----------------------------------------------------------------

def _value(node: tuple, filters):
    """Closure from the variables to the expression's value."""
    kind = node[0]
    if kind == "constant":
        constant = node[1]
        return lambda env: constant
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "field":
        base, name = _value(node[1], filters), node[2]

        def field(env):
            held = base(env)
            return held.get(name) if type(held) is dict else None
        return field
    if kind == "filter":
        inner, run = _value(node[2], filters), filters[node[1]]
        return lambda env: run(inner(env))
    if kind == "not":
        inner = _value(node[1], filters)
        return lambda env: not inner(env)
    left, right = (_value(x, filters) for x in node[-2:])
    if kind == "and":
        return lambda env: left(env) and right(env)
    if kind == "or":
        return lambda env: left(env) or right(env)
    run = OPS[node[1]]
    return lambda env: run(left(env), right(env))


def _outputs(nodes: list, filters):
    """Closure from variables and messages to a generator of (text, in the
    loss, number of the message or -1)."""
    steps = [_output(n, filters) for n in nodes]

    def run(env, messages, masked):
        for step in steps:
            yield from step(env, messages, masked)
    return run


def _output(node: tuple, filters):
    kind = node[0]
    if kind == "for":
        name, body = node[1], _outputs(node[2], filters)

        def loop(env, messages, masked):
            messages = iter(messages)
            ahead = next(messages, None)
            k = 0
            while ahead is not None:
                message, ahead = ahead, next(messages, None)
                env[name], env["loop"] = message, {"index": k + 1, "index0": k, "first": k == 0, "last": ahead is None}
                yield from body(env, (), masked)
                k += 1
            env.pop("loop", None)
        return loop
    if kind == "if":
        cases = [(_value(t, filters), _outputs(b, filters)) for t, b in node[1]]

        def choose(env, messages, masked):
            for test, body in cases:
                if test(env):
                    yield from body(env, messages, masked)
                    return
        return choose
    if kind == "set":
        name, value = node[1], _value(node[2], filters)

        def put(env, messages, masked):
            env[name] = value(env)
            return iter(())
        return put
    if kind == "generation":
        body = _outputs(node[1], filters)
        return lambda env, messages, masked: body(env, messages, True)
    value = _value(node, filters)

    def write(env, messages, masked):
        yield text_of(value(env)), masked, env["loop"]["index0"] if "loop" in env else -1
    return write


def compile_template(source: str, filters: dict | None = None):
    """render(messages, **values) -> generator of (text, in the loss, number of
    the message it was written for, -1 outside the loop)."""
    filters = filters or {}
    run = _outputs(fold(parse(source, filters), filters)[1], filters)

    def render(messages, **values):
        yield from run(dict(values), messages, False)

    return render
