"""Chat formatting: a small sandboxed template language, compiled to Python closures that render conversations and mark what the model is to learn.

Language: text, {{ expression }}, {% for x in e %}..{% endfor %}, {% if e %}..{% elif e %}..{% else %}..{% endif %}, {% set x = e %}, {% generation %}..{% endgeneration %}.
A minus inside a tag's bracket ({%- -%}, {{- -}}) takes away the white space on that side; {# #} is a comment; strings may hold any bracket.
Expressions: literals, names, a.b and a['b'] on mappings, a[0] and a[-1] on lists, not/and/or, == != < > <= >= in, not in, is (not) defined/none/string, + - * % and ~ (join as
text), x if c else y, filters with |. Whatever goes wrong, when a template is read or rendered, is a TemplateError.
Nothing else of Python can be reached: no calls, no attributes of objects, no imports.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns as <|im_start|>role\n text <|im_end|>\n; under the loss mask: assistant texts.
CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' }}{{ m.role | line | escape }}{{ '\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\n' }}{% endfor %}"
)
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


class TemplateError(ValueError):
    """The template isn't in the language, or a value isn't there."""


def escape(text: str) -> str:
    r"""Control strings start with <|; inside texts, < and | never stand side by side: a backslash more goes between them than there was."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def one_line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def many_lines(text: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", text)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(as_text(v)), "line": lambda v: one_line(as_text(v)), "trim": lambda v: as_text(v).strip(),
    "upper": lambda v: as_text(v).upper(), "lower": lambda v: as_text(v).lower(), "length": len,
}


def as_text(value) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


@dataclass
class Node:
    """A part of the syntax tree: kind, plain values, and the parts below."""

    kind: str
    value: object = None
    parts: list = field(default_factory=list)


#: A tag, up to the bracket that closes it outside strings.
TAG = re.compile(
    r"(?P<show>\{\{(?:[^'\"}]|\}(?!\})|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")*\}\})|(?P<tag>\{%(?:[^'\"%]|%(?!\})|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")*%\})|(?P<note>\{#.*?#\})", re.S
)
#: Parts within parts, at most.
DEPTH = 100
TOKEN = re.compile(r"\s*(?:(?P<number>\d+)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-<>|+~*%.\[\]()]))")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Parser:
    def __init__(self, source: str):
        self.pieces, self.at, self.depth, end, trim = [], 0, 0, 0, False
        for m in [*TAG.finditer(source), None]:
            text = source[end : m.start() if m else len(source)]
            if "{{" in text or "{%" in text:
                raise TemplateError("a tag isn't closed")
            text = text.lstrip() if trim else text
            inside = m[0][2:-2] if m else ""
            text = text.rstrip() if inside[:1] == "-" else text
            if text:
                self.pieces.append(("text", text))
            if m and m.lastgroup != "note":
                self.pieces.append((m.lastgroup, inside.removeprefix("-").removesuffix("-")))
            end, trim = m.end() if m else end, inside[-1:] == "-"

    def deeper(self, by: int) -> None:
        self.depth += by
        if self.depth > DEPTH:
            raise TemplateError(f"parts within parts more than {DEPTH} deep")

    def template(self) -> Node:
        tree, end = self.body(())
        return tree

    def body(self, stops: tuple[str, ...]) -> tuple[Node, list]:
        parts = []
        self.deeper(1)
        while self.at < len(self.pieces):
            kind, piece = self.pieces[self.at]
            self.at += 1
            if kind == "show":
                parts.append(Node("show", parts=[self.expression(piece)]))
            elif kind == "tag":
                words = self.tokens(piece)
                if not words:
                    raise TemplateError("empty tag")
                if words[0][1] in stops:
                    self.deeper(-1)
                    return Node("body", parts=parts), words
                parts.append(self.tag(words))
            else:
                parts.append(Node("text", piece))
        if stops:
            raise TemplateError(f"missing {' or '.join(stops)}")
        self.deeper(-1)
        return Node("body", parts=parts), []

    def tag(self, words: list) -> Node:
        name = words[0][1]
        if name == "for":
            if len(words) < 4 or words[1][0] != "name" or words[2][1] != "in":
                raise TemplateError("for x in ...")
            over = self.parse(words[3:])
            body, _ = self.body(("endfor",))
            return Node("for", words[1][1], [over, body])
        if name == "if":
            arms, words = [], words
            while words[0][1] in ("if", "elif"):
                test = self.parse(words[1:])
                body, words = self.body(("elif", "else", "endif"))
                arms += [test, body]
            if words[0][1] == "else":
                arms.append(self.body(("endif",))[0])
            return Node("if", parts=arms)
        if name == "set":
            if len(words) < 4 or words[1][0] != "name" or words[2][1] != "=":
                raise TemplateError("set x = ...")
            return Node("set", words[1][1], [self.parse(words[3:])])
        if name == "generation":
            return Node("generation", parts=[self.body(("endgeneration",))[0]])
        raise TemplateError(f"unknown tag {name}")

    @staticmethod
    def tokens(source: str) -> list[tuple[str, object]]:
        out, at, source = [], 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if m:
                kind = m.lastgroup
                value = m[kind]
                if kind == "number":
                    value = int(value)
                elif kind == "text":
                    value = re.sub(r"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), value[1:-1], flags=re.S)
                out.append((kind, value))
                at = m.end()
            elif source[at] == "=":
                out.append(("sign", "="))
                at += 1
            elif source[at].isspace():
                at += 1
            else:
                raise TemplateError(f"unexpected {source[at]!r}")
        return out

    def expression(self, source: str) -> Node:
        return self.parse(self.tokens(source))

    def parse(self, words: list) -> Node:
        self.words, self.pos = words, 0
        node = self.choice()
        if self.pos < len(words):
            raise TemplateError(f"unexpected {words[self.pos][1]!r}")
        return node

    def take(self, *values) -> object:
        if self.pos < len(self.words) and self.words[self.pos][0] in ("sign", "name") and self.words[self.pos][1] in values:
            self.pos += 1
            return self.words[self.pos - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"missing {value}")

    def choice(self) -> Node:
        self.deeper(1)
        node = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            node = Node("choice", parts=[test, node, self.choice()])
        self.deeper(-1)
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
        if self.take("not"):
            self.deeper(1)
            node = Node("not", parts=[self.negated()])
            self.deeper(-1)
            return node
        node = self.joined()
        if self.take("is"):
            no, name = self.take("not"), self.next("name")
            if name not in TESTS:
                raise TemplateError(f"unknown test {name}")
            node = Node("test", name, [node])
            return Node("not", parts=[node]) if no else node
        if self.take("not"):
            self.need("in")
            return Node("not", parts=[Node("compare", "in", [node, self.joined()])])
        sign = self.take("==", "!=", "<=", ">=", "<", ">", "in")
        return Node("compare", sign, [node, self.joined()]) if sign else node

    def joined(self) -> Node:
        node = self.product()
        while sign := self.take("+", "-", "~"):
            node = Node("join", sign, [node, self.product()])
        return node

    def product(self) -> Node:
        node = self.filtered()
        while sign := self.take("*", "%"):
            node = Node("join", sign, [node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = Node("item", parts=[node, Node("constant", self.next("name"))])
            elif self.take("["):
                node = Node("item", parts=[node, self.choice()])
                self.need("]")
            elif self.take("|"):
                name = self.next("name")
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name}")
                node = Node("filter", name, [node])
            else:
                return node

    def next(self, kind: str):
        if self.pos >= len(self.words) or self.words[self.pos][0] != kind:
            raise TemplateError(f"{kind} expected")
        self.pos += 1
        return self.words[self.pos - 1][1]

    def atom(self) -> Node:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.take("-"):
            return Node("constant", -self.next("number"))
        if self.pos >= len(self.words):
            raise TemplateError("expression expected")
        kind, value = self.words[self.pos]
        self.pos += 1
        if kind in ("number", "text"):
            return Node("constant", value)
        if kind == "name":
            return Node("constant", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Node("name", value)
        raise TemplateError(f"unexpected {value!r}")


COMPARE = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}
TESTS = {"defined": lambda v: True, "none": lambda v: v is None, "string": lambda v: isinstance(v, str)}


def modulo(a, b):
    if isinstance(a, str):
        raise TemplateError("% is for numbers")
    return a % b


def times(a, b):
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("* is for numbers")
    return a * b


JOIN = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": times, "%": modulo, "~": lambda a, b: as_text(a) + as_text(b)}
PURE = {"choice", "or", "and", "not", "compare", "join", "item", "filter"}


def fold(node: Node) -> Node:
    """Parts without names become constants; shown constants become text; text joins text; arms that can't be reached go."""
    parts = [fold(p) for p in node.parts]
    node = Node(node.kind, node.value, parts)
    if node.kind in PURE and all(p.kind == "constant" for p in parts):
        return Node("constant", value_of(node)({}))
    if node.kind == "show" and parts[0].kind == "constant":
        return Node("text", as_text(parts[0].value))
    if node.kind == "if":
        arms = []
        for k in range(0, len(parts) - 1, 2):
            if parts[k].kind != "constant":
                arms += parts[k : k + 2]
            elif parts[k].value:
                arms.append(parts[k + 1])
                break
        else:
            arms += parts[len(parts) - 1 :] if len(parts) % 2 else []
        return arms[0] if len(arms) == 1 else Node("if", parts=arms)
    if node.kind == "body":
        flat, out = [x for p in parts for x in (p.parts if p.kind == "body" else [p])], []
        for p in flat:
            if p.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + p.value)
            elif p.kind != "text" or p.value:
                out.append(p)
        return Node("body", parts=out)
    return node


def value_of(node: Node) -> Callable[[dict], object]:
    """A closure: names to the expression's value."""
    below = [value_of(p) for p in node.parts]
    if node.kind == "constant":
        value = node.value
        return lambda env: value
    if node.kind == "name":
        name = node.value

        def look(env):
            if name not in env:
                raise TemplateError(f"unknown name {name}")
            return env[name]

        return look
    if node.kind == "item":
        whole, key = below

        def item(env):
            value, k = whole(env), key(env)
            if isinstance(value, dict) or isinstance(value, list | tuple) and isinstance(k, int):
                try:
                    return value[k]
                except (KeyError, IndexError):
                    raise TemplateError(f"no item {k!r}") from None
            raise TemplateError("only mappings and lists have items")

        return item
    if node.kind == "filter":
        call, of = FILTERS[node.value], below[0]
        return lambda env: call(of(env))
    if node.kind == "join":
        join, (a, b) = JOIN[node.value], below
        return lambda env: join(a(env), b(env))
    if node.kind == "test":
        test, of = TESTS[node.value], below[0]

        def holds(env):
            try:
                value = of(env)
            except TemplateError:
                if node.value == "defined":
                    return False
                raise
            return test(value)

        return holds
    if node.kind == "compare":
        test, (a, b) = COMPARE[node.value], below
        return lambda env: test(a(env), b(env))
    if node.kind == "not":
        return lambda env: not below[0](env)
    if node.kind == "and":
        return lambda env: below[0](env) and below[1](env)
    if node.kind == "or":
        return lambda env: below[0](env) or below[1](env)
    if node.kind == "choice":
        return lambda env: below[1](env) if below[0](env) else below[2](env)
    raise TemplateError(f"{node.kind} isn't an expression")


def writer_of(node: Node) -> Callable[[dict, Callable[[str, bool], None], bool], None]:
    """A closure: names, where text goes, and whether the loss mask is on."""
    if node.kind == "text":
        text = node.value
        return lambda env, emit, on: emit(text, on)
    if node.kind == "show":
        value = value_of(node.parts[0])
        return lambda env, emit, on: emit(as_text(value(env)), on)
    if node.kind == "set":
        value, name = value_of(node.parts[0]), node.value
        return lambda env, emit, on: env.__setitem__(name, value(env))
    if node.kind == "generation":
        body = writer_of(node.parts[0])
        return lambda env, emit, on: body(env, emit, True)
    if node.kind == "body":
        parts = [writer_of(p) for p in node.parts]

        def write(env, emit, on):
            for part in parts:
                part(env, emit, on)

        return write
    if node.kind == "for":
        over, body, name = value_of(node.parts[0]), writer_of(node.parts[1]), node.value

        def loop(env, emit, on):
            items = list(over(env))
            for k, item in enumerate(items):
                body(env | {name: item, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": k + 1 == len(items), "length": len(items)}}, emit, on)

        return loop
    if node.kind == "if":
        tests = [(value_of(node.parts[k]), writer_of(node.parts[k + 1])) for k in range(0, len(node.parts) - 1, 2)]
        last = writer_of(node.parts[-1]) if len(node.parts) % 2 else None

        def choose(env, emit, on):
            for test, body in tests:
                if test(env):
                    return body(env, emit, on)
            if last:
                last(env, emit, on)

        return choose
    raise TemplateError(f"{node.kind} can't be written")


#: What may go wrong in Python where a value isn't of the kind that an operation takes.
WRONG = (TypeError, ValueError, ArithmeticError, LookupError, AttributeError, RecursionError)


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """names -> (text, spans under the loss mask as code point ranges, end excluded)."""
    try:
        write = writer_of(fold(Parser(source).template()))
    except WRONG as error:
        raise TemplateError(str(error)) from None

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out, spans, size = [], [], 0

        def emit(text: str, on: bool) -> None:
            nonlocal size
            if text:
                out.append(text)
                if on:
                    spans.append((size, size + len(text)))
                size += len(text)

        try:
            write(dict(names), emit, False)
        except WRONG as error:
            raise TemplateError(str(error)) from None
        return "".join(out), spans

    return render


_compiled: dict[str, Callable] = {}


def template(source: str) -> Callable:
    if source not in _compiled:
        _compiled[source] = compile_template(source)
    return _compiled[source]


def format_conversations(rows: DataFrame, source: str = CHATML) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, text, loss_spans (array of start, end).

    rows: conv_id, turn, role, text; a null role or text is empty. Turns are in the order of turn, then role and text; rows of a null conv_id are one conversation. An
    empty table gives no rows; rows that stand twice are two turns; texts may have any length; other columns, whatever their names, are ignored. A broken template fails
    before any task runs.
    """
    compile_template(source)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    @F.pandas_udf("struct<text string, spans array<struct<start:long,end:long>>>")
    def render(turns: pd.Series) -> pd.DataFrame:
        done = [template(source)({"messages": [{"role": t["role"], "text": t["text"]} for t in x]}) for x in turns]
        return pd.DataFrame({"text": [t for t, _ in done], "spans": [[{"start": a, "end": b} for a, b in s] for _, s in done]})

    made = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), render("turns").alias("made"))
    return made.select("conv_id", "n_turns", F.col("made.text").alias("text"), F.col("made.spans").alias("loss_spans"))


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that CHATML made; anything between turns is an error."""
    out, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((many_lines(unescape(m[1])), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text between turns")
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    @F.pandas_udf("struct<n long, turns string, chars long, loss string, size long>")
    def read(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(text, spans, strict=True):
            turns = read_turns(t)
            loss = "".join(unescape(t[x["start"] : x["end"]]) for x in s)
            every = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(t)))
        return pd.DataFrame(out, columns=["n", "turns", "chars", "loss", "size"])

    r = formatted.select("conv_id", read("text", "loss_spans").alias("r"))
    return r.select("conv_id", F.col("r.n").alias("n_turns"), F.col("r.turns").alias("turns_sha256"), F.col("r.chars").alias("loss_chars"), F.col("r.loss").alias("loss_sha256"), F.col("r.size").alias("formatted_chars"))
