"""Chat formatting with a compiled, sandboxed template language.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes nested Python closures that
append pieces to an output and note which pieces were generated.  The language has text, ``{{ expression }}``,
``{% for x in y %}``, ``{% if %} / {% elif %} / {% else %}``, ``{% set x = ... %}`` and ``{% generation %}``.
Expressions know strings, integers, true, false, none, names, ``.field`` and ``[...]`` of messages and lists,
``==``, ``!=``, ``not``, ``and``, ``or``, ``+`` and the filters below.  There are no calls and no attributes of
Python objects, so a template reaches nothing but the conversation it formats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CHAT = ("{% for m in messages %}" + OPEN + "{{ m.role | line | escape }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}"
        "{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}" + CLOSE + "\n{% endfor %}")


def escape(text: str) -> str:
    """No ``<|`` is left: one more backslash goes between ``<`` and ``|``, whatever number is there."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def one_line(text: str) -> str:
    return text.replace("%", "%25").replace("\n", "%0A")


def any_line(text: str) -> str:
    return text.replace("%0A", "\n").replace("%25", "%")


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "line": one_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}
TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.()\[\]+]))")


class TemplateError(ValueError):
    """The template can't be parsed."""


class _Expression:
    """Recursive descent over one expression's tokens, giving a tree of tuples."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> tuple[str, str]:
        if self.at >= len(self.tokens) or values and not self.peek(*values):
            raise TemplateError(f"expected {values or 'a value'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def tree(self):
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.peek("or"):
            self.take()
            out = ("or", out, self.both())
        return out

    def both(self):
        out = self.negated()
        while self.peek("and"):
            self.take()
            out = ("and", out, self.negated())
        return out

    def negated(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        out = self.total()
        if self.peek("==", "!="):
            out = (self.take()[1], out, self.total())
        return out

    def total(self):
        out = self.filtered()
        while self.peek("+"):
            self.take()
            out = ("+", out, self.filtered())
        return out

    def filtered(self):
        out = self.value()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = ("filter", name, out)
        return out

    def value(self):
        kind, word = self.take()
        if kind == "str":
            out = ("const", word[1:-1])
        elif kind == "int":
            out = ("const", int(word))
        elif word == "(":
            out = self.either()
            self.take(")")
        elif kind == "name":
            out = ("const", {"true": True, "false": False, "none": None}[word]) if word in ("true", "false", "none") else ("name", word)
        else:
            raise TemplateError(f"unexpected {word!r}")
        while self.peek(".", "["):
            if self.take()[1] == ".":
                kind, word = self.take()
                if kind != "name":
                    raise TemplateError("a field has a name")
                out = ("item", out, ("const", word))
            else:
                out = ("item", out, self.either())
                self.take("]")
        return out


def parse(source: str) -> list[tuple]:
    """Syntax tree of a template: a list of nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(("emit", _Expression(part[2:-2]).tree()))
            elif part.startswith("{%"):
                tag = part[2:-2].strip()
                word, _, rest = tag.partition(" ")
                if word in ends:
                    return out, tag
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"bad loop {tag!r}")
                    body, _ = block("endfor")
                    out.append(("for", m[1], _Expression(m[2]).tree(), body))
                elif word == "if":
                    arms, other, test = [], [], rest
                    while True:
                        body, end = block("elif", "else", "endif")
                        arms.append((_Expression(test).tree(), body))
                        if end.startswith("elif"):
                            test = end[4:]
                            continue
                        if end == "else":
                            other, _ = block("endif")
                        break
                    out.append(("if", arms, other))
                elif word == "set":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(.*)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"bad assignment {tag!r}")
                    out.append(("set", m[1], _Expression(m[2]).tree()))
                elif word == "generation":
                    body, _ = block("endgeneration")
                    out.append(("generation", body))
                else:
                    raise TemplateError(f"unexpected {tag!r}")
            elif part:
                out.append(("text", part))
        if ends:
            raise TemplateError(f"missing {ends[-1]!r}")
        return out, ""

    return block()[0]


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if key < len(value) else None
    return None


APPLY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
         "item": _item, "not": lambda a: not a}


def fold(node: tuple) -> tuple:
    """An expression with its constant parts computed."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    parts = [fold(x) for x in node[1:]]
    if kind in ("and", "or"):
        if parts[0][0] == "const":
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
        return (kind, *parts)
    if all(p[0] == "const" for p in parts):
        return ("const", APPLY[kind](*[p[1] for p in parts]))
    return (kind, *parts)


def fold_block(nodes: list[tuple]) -> list[tuple]:
    """A block whose constant output is text, neighbouring texts joined, and branches decided where they can be."""
    out: list[tuple] = []
    for node in nodes:
        kind, new = node[0], [node]
        if kind == "emit":
            inner = fold(node[1])
            new = [("text", _text(inner[1]))] if inner[0] == "const" else [("emit", inner)]
        elif kind == "for":
            new = [("for", node[1], fold(node[2]), fold_block(node[3]))]
        elif kind == "set":
            new = [("set", node[1], fold(node[2]))]
        elif kind == "generation":
            new = [("generation", fold_block(node[1]))]
        elif kind == "if":
            arms, other = [], fold_block(node[2])
            for test, body in [(fold(t), fold_block(b)) for t, b in node[1]]:
                if test[0] == "const" and not test[1]:
                    continue
                if test[0] == "const":
                    other = body
                    break
                arms.append((test, body))
            new = [("if", arms, other)] if arms else other
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda names, value=node[1]: value
    if kind == "name":
        return lambda names, name=node[1]: names.get(name)
    if kind == "filter":
        inner, apply = _value(node[2]), FILTERS[node[1]]
        return lambda names: apply(_text(inner(names)))
    parts = [_value(x) for x in node[1:]]
    if kind == "and":
        return lambda names: parts[0](names) and parts[1](names)
    if kind == "or":
        return lambda names: parts[0](names) or parts[1](names)
    apply = APPLY[kind]
    if len(parts) == 1:
        return lambda names: apply(parts[0](names))
    return lambda names: apply(parts[0](names), parts[1](names))


def _closure(nodes: list[tuple]) -> Callable[[dict, list, list], None]:
    """Closure of a block: appends to the pieces; generated pieces are noted as (first, last) piece numbers."""
    steps = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            steps.append(lambda names, out, marks, text=node[1]: out.append(text))
        elif kind == "emit":
            steps.append(lambda names, out, marks, value=_value(node[1]): out.append(_text(value(names))))
        elif kind == "set":
            steps.append(lambda names, out, marks, name=node[1], value=_value(node[2]): names.__setitem__(name, value(names)))
        elif kind == "for":
            def loop(names, out, marks, name=node[1], value=_value(node[2]), body=_closure(node[3])):
                for x in value(names) or ():
                    names[name] = x
                    body(names, out, marks)
            steps.append(loop)
        elif kind == "if":
            def choose(names, out, marks, arms=[(_value(t), _closure(b)) for t, b in node[1]], other=_closure(node[2])):
                for test, body in arms:
                    if test(names):
                        return body(names, out, marks)
                return other(names, out, marks)
            steps.append(choose)
        else:
            def generated(names, out, marks, body=_closure(node[1])):
                first = len(out)
                body(names, out, marks)
                marks.append((first, len(out)))
            steps.append(generated)

    def run(names, out, marks):
        for step in steps:
            step(names, out, marks)

    return run


def compiled(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """Function from messages to the formatted text and the (start, end) code point spans that were generated."""
    body = _closure(fold_block(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out: list[str] = []
        marks: list[tuple[int, int]] = []
        body({"messages": messages}, out, marks)
        at = [0]
        for piece in out:
            at.append(at[-1] + len(piece))
        return "".join(out), [(at[a], at[b]) for a, b in marks]

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that ``CHAT`` formatted."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE + "\n", line + 1)
        out.append((any_line(unescape(formatted[at + len(OPEN):line])), unescape(formatted[line + 1:end])))
        at = end + len(CLOSE) + 1
    return out


def format_conversations(rows: DataFrame, template: str = CHAT) -> DataFrame:
    """``conv_id``, ``formatted`` and ``spans`` (array of start, end) of conversations given by (conv_id, turn, role, text).

    Turns are in order of turn, then role, then text, nulls first; repeated rows are turns of their own.  A null role
    or text is empty; rows without ``conv_id`` make one conversation without id.  One conversation is one cell, so
    its length is bounded as that of any text is.  No rows give no rows; other columns are not read.
    """
    compiled(template)  # a wrong template fails here and not in the tasks
    turns = (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("m"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        for batch in batches:
            done = [render(m) for m in batch.column("messages").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([d[0] for d in done], pa.string()),
                 pa.array([[{"start": a, "end": b} for a, b in d[1]] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["conv_id", "formatted", "spans"])

    return turns.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start: long, end: long>>")


def format_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when read back: turns, and the text under the loss mask."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                rows.append((conv_id, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                             len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, KINDS)], NAMES)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
