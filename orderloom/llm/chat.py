"""Conversations as training text, by a compiled template.

A template is parsed into a syntax tree, constant parts are folded, and each node becomes a Python closure. The
language: ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for message in messages %}``,
``{% generation %} ... {% endgeneration %}``. Expressions have strings, numbers, true, false, none, names, the
fields ``message.role``, ``message.text``, ``loop.index``, ``loop.first``, ``loop.last``, the operators
``or and not == != in + ~`` with brackets, and the filters ``escape trim upper lower length``. There is nothing
else to call or reach, so a template cannot touch anything but the conversation.

Text goes out piece by piece, one piece for what precedes the messages, one for each message, one for what
follows, so a conversation of any length passes through a task without being held.

The control strings of ``CONTROLS`` never occur in escaped text: where a text has one, a backslash goes in after
its first character, and where a text has a control string with backslashes there already, one more. Taking one
out again gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>")
TEMPLATE = (
    "<s>{% for message in messages %}<|turn|>{{ message.role | escape }}<|text|>"
    "{% if message.role == 'user' %}[INST] {% endif %}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{% if message.role == 'user' %} [/INST]{% endif %}<|end|>\n{% endfor %}</s>"
)

_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_GUARD = re.compile(rf"([<\[])(?=\\*(?:{_RESTS}))")
_UNGUARD = re.compile(rf"([<\[])\\(?=\\*(?:{_RESTS}))")


def escape(text: str) -> str:
    return _GUARD.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNGUARD.sub(r"\1", text)


class TemplateError(ValueError):
    pass


# --- syntax tree ------------------------------------------------------------------------------------------
# Nodes are tuples: (kind, ...). Statements: text, out, if, for, generation. Expressions: const, name, field,
# filter, not, and, or, binary operators.

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKENS = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.()+~]))""")
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(_text(v)),
}
OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: _text(a) in _text(b),
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
}
FIELDS = {"message": ("role", "text"), "loop": ("index", "first", "last")}


def _text(value: Any) -> str:
    return "" if value is None else str(value)


class _Expression:
    """A recursive-descent reader: or, and, not, comparison, sum, filters, atoms."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            string, number, word, mark = m.groups()
            if string is not None:
                body = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), string[1:-1], flags=re.S)
                self.tokens.append(("const", body))
            elif number is not None:
                self.tokens.append(("const", int(number)))
            else:
                self.tokens.append(("word" if word else "mark", word or mark))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while op := self.take("==", "!=", "in"):
            node = (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while op := self.take("+", "~"):
            node = (op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is open")
            return node
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return self.tokens[self.at - 1]
        name = self.word()
        if name in _WORDS:
            return ("const", _WORDS[name])
        if name in FIELDS and self.take("."):
            field = self.word()
            if field not in FIELDS[name]:
                raise TemplateError(f"{name} has no field {field!r}")
            return ("field", name, field)
        raise TemplateError(f"no name {name!r}")


def parse(template: str) -> tuple:
    """The statements of a template."""
    parts, at = [], 0
    for m in _TAGS.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))
    parts.reverse()

    def block(ends: tuple[str, ...], inside: str) -> tuple[tuple, str]:
        nodes = []
        while parts:
            kind, body = parts.pop()
            if kind == "text":
                nodes.append(("text", body))
                continue
            if kind == "out":
                nodes.append(("out", _Expression(body).whole()))
                continue
            word = body.split(None, 1)[0] if body else ""
            if word in ends:
                return tuple(nodes), body
            if word == "if":
                nodes.append(choice(body[2:], inside))
            elif re.fullmatch(r"for\s+message\s+in\s+messages", body) and not inside:
                inner, _ = block(("endfor",), "for")
                nodes.append(("for", inner))
            elif body == "generation" and inside != "generation":
                inner, _ = block(("endgeneration",), "generation")
                nodes.append(("generation", inner))
            else:
                raise TemplateError(f"unexpected tag {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""

    def choice(condition: str, inside: str) -> tuple:
        yes, end = block(("elif", "else", "endif"), inside)
        if end.startswith("elif"):
            no: tuple = (choice(end[4:], inside),)
        elif end == "else":
            no, _ = block(("endif",), inside)
        else:
            no = ()
        return ("if", _Expression(condition).whole(), yes, no)

    return block((), "")[0]


def fold(node: tuple) -> tuple:
    """An expression with its constant parts worked out."""
    kind = node[0]
    if kind in ("const", "field"):
        return node
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    inner = tuple(fold(n) for n in node[1:])
    if all(n[0] == "const" for n in inner):
        return ("const", _value((kind, *inner))({}))
    if kind in ("and", "or") and inner[0][0] == "const":
        return inner[1] if bool(inner[0][1]) == (kind == "and") else inner[0]
    return (kind, *inner)


def fold_all(nodes: Iterable[tuple]) -> tuple:
    """Statements with constants folded: fixed choices taken, texts next to each other joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "out":
            value = fold(node[1])
            add(("text", _text(value[1])) if value[0] == "const" else ("out", value))
        elif node[0] == "if":
            condition, yes, no = fold(node[1]), fold_all(node[2]), fold_all(node[3])
            if condition[0] == "const":
                for inner in yes if condition[1] else no:
                    add(inner)
            else:
                add(("if", condition, yes, no))
        elif node[0] in ("for", "generation"):
            add((node[0], fold_all(node[1])))
        else:
            add(node)
    return tuple(out)


# --- closures ---------------------------------------------------------------------------------------------


def _value(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda names, v=node[1]: v
    if kind == "field":

        def field(names: dict, of: str = node[1], name: str = node[2]) -> Any:
            if of not in names:
                raise TemplateError(f"{of} outside the loop")
            return names[of][name]

        return field
    if kind == "filter":
        return lambda names, f=FILTERS[node[1]], v=_value(node[2]): f(v(names))
    if kind == "not":
        return lambda names, v=_value(node[1]): not v(names)
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    return lambda names, f=OPERATORS[kind]: f(a(names), b(names))


class _Piece:
    """Text on its way out, and where the parts lie that are to be learned."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def result(self) -> tuple[str, list[tuple[int, int]]]:
        return "".join(self.parts), self.spans


def _writer(nodes: tuple) -> Callable[[dict, _Piece], None]:
    """One closure for statements without a loop."""
    steps: list[Callable[[dict, _Piece], None]] = []
    for node in nodes:
        if node[0] == "text":
            steps.append(lambda names, piece, t=node[1]: piece.add(t))
        elif node[0] == "out":
            steps.append(lambda names, piece, v=_value(node[1]): piece.add(_text(v(names))))
        elif node[0] == "if":
            yes, no = _writer(node[2]), _writer(node[3])
            steps.append(lambda names, piece, v=_value(node[1]), y=yes, n=no: (y if v(names) else n)(names, piece))
        elif node[0] == "generation":

            def marked(names: dict, piece: _Piece, inner: Callable = _writer(node[1])) -> None:
                start = piece.length
                inner(names, piece)
                if piece.length > start:
                    piece.spans.append((start, piece.length))

            steps.append(marked)
        else:
            raise TemplateError("a loop stands alone, not inside another tag")

    def run(names: dict, piece: _Piece) -> None:
        for step in steps:
            step(names, piece)

    return run


def compile_template(template: str) -> Callable[[Iterable[tuple[str, str]]], Iterator[tuple[str, list]]]:
    """A generator function from (role, text) messages to pieces (text, learned spans)."""
    nodes = fold_all(parse(template))
    loops = [i for i, n in enumerate(nodes) if n[0] == "for"]
    if len(loops) > 1:
        raise TemplateError("messages are read once, so there is one loop at most")
    at = loops[0] if loops else len(nodes)
    before, after = _writer(nodes[:at]), _writer(nodes[at + 1 :])
    body = _writer(nodes[at][1]) if loops else None

    def render(messages: Iterable[tuple[str, str]]) -> Iterator[tuple[str, list]]:
        piece = _Piece()
        before({}, piece)
        yield piece.result()
        if body:
            ahead = iter(messages)
            now, index = next(ahead, None), 0
            while now is not None:
                following = next(ahead, None)
                loop = {"index": index + 1, "first": index == 0, "last": following is None}
                piece = _Piece()
                body({"message": {"role": now[0], "text": now[1]}, "loop": loop}, piece)
                yield piece.result()
                now, index = following, index + 1
        piece = _Piece()
        after({}, piece)
        yield piece.result()

    return render


# --- tables -----------------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """Runs of rows with one first value, each as an iterator; the rows of a run are not held."""
    row = next(rows, None)
    while row is not None:
        key, box = row[0], [row]

        def run() -> Iterator[tuple]:
            while box[0] is not None and box[0][0] == key:
                now, box[0] = box[0], None
                yield now
                box[0] = next(rows, None)

        yield key, run()
        row = box[0]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_ID = T.StructField("conv_id", T.LongType())
PIECES = T.StructType(
    [
        _ID,
        T.StructField("piece", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
    ]
)
_PIECES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("piece", pa.int64()),
        ("text", pa.string()),
        ("starts", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
    ]
)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, piece, text, starts, ends): formatted text in pieces by conversation, in order within a partition.

    The pieces of a conversation, joined by number, are its text; starts and ends are the parts of a piece to be
    learned, in code points. Turns go by number, equal numbers by role and text, NULLs first; a NULL role or text
    is empty, a NULL conv_id is a conversation of its own, repeated rows are repeated turns, other columns are
    not read, and without turns there is nothing. Partitions hold whole conversations; a task streams them.
    """
    compile_template(template)  # an error in it shows here
    slim = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def pieces() -> Iterator[tuple]:
            for conv, rows in _groups(_rows(batches)):
                for n, (text, spans) in enumerate(render((r[1], r[2]) for r in rows)):
                    yield conv, n, text, [a for a, _ in spans], [b for _, b in spans]

        yield from _batches(pieces(), _PIECES)

    return ordered.select("conv_id", "role", "text").mapInArrow(run, PIECES)


_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def _without_marks(role: str, body: str) -> str:
    return body[len("[INST] ") : -len(" [/INST]")] if role == "user" else body


def read_back(pieces: DataFrame) -> DataFrame:
    """What formatted text says again: turns and learned text of each conversation, as counts and digests.

    Reads the output of ``format_chats`` with the default template, whose partitions hold whole conversations in
    order; pieces that come from elsewhere are brought into that order first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            for conv, rows in _groups(_rows(batches)):
                turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, _, text, starts, ends in rows:
                    chars += len(text)
                    for m in _TURN.finditer(text):
                        role = unescape(m[1])
                        n += 1
                        turns.update(f"{role}\n{unescape(_without_marks(role, m[2]))}\n".encode())
                    for a, b in zip(starts, ends):
                        learned = unescape(text[a:b])
                        loss_chars += len(learned)
                        loss.update(learned.encode())
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _batches(conversations(), _DIGESTS)

    return pieces.mapInArrow(run, DIGESTS)


def in_order(pieces: DataFrame) -> DataFrame:
    """Stored pieces in the order that ``read_back`` needs."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
