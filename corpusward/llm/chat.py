"""Chat formatting: a small template compiler and a streaming renderer.

Templates have text, ``{{ expression }}``, ``{% for m in messages %}``, ``{% if %}
{% elif %} {% else %}`` and ``{% generation %}`` blocks.  A template is parsed into a
syntax tree, constants are folded, and Python closures are generated that yield
pieces of output; a piece inside a generation block is under the loss mask.  The
sandbox has no attribute of a Python object, no call but the filters listed here and
no loop but that over the messages.

Control strings inside texts are escaped with a backslash after their first
character, and backslashes are doubled, so that the output can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values. Each starts with ``<`` or ``[`` and has neither of them further on, so that no
#: text can complete one that a mark begins, nor the other way round.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[BOT]", "[ROLE]", "[/ROLE]")

TEMPLATE = (
    "{{ '<s>' }}{% for m in messages %}"
    "{% if m.role == 'user' %}{{ '[INST]' }} {{ m.text | escape }} {{ '[/INST]' }}"
    "{% elif m.role == 'assistant' %}{{ '[BOT]' }} {% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}"
    "{% elif m.role == 'system' %}{{ '[SYS]' }} {{ m.text | escape }} {{ '[/SYS]' }}"
    "{% else %}{{ '[ROLE]' }}{{ m.role | escape }}{{ '[/ROLE]' }} {{ m.text | escape }}{{ '</s>' }}"
    "{% endif %}{% endfor %}"
)

_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


#: What a template may call.
FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is not in the language."""


# ---------------------------------------------------------------- syntax tree: tuples (kind, ...)

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\d+|[A-Za-z_]\w*|==|!=|[.|+()])")


def _lex(source: str) -> list[str]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 20]!r}")
        out.append(m[1])
        at = m.end()
    return out


class _Expression:
    """Recursive descent over: or, and, not, == and !=, +, filters, names and literals."""

    def __init__(self, source: str):
        self.tokens = _lex(source)
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if wanted and token not in wanted:
            raise TemplateError(f"expected {' or '.join(wanted)}, got {token!r}")
        self.at += 1
        return token

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek():
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def _left(self, below: Callable[[], tuple], *signs: str) -> tuple:
        tree = below()
        while self.peek() in signs:
            tree = (self.take(), tree, below())
        return tree

    def either(self) -> tuple:
        return self._left(self.both, "or")

    def both(self) -> tuple:
        return self._left(self.negation, "and")

    def negation(self) -> tuple:
        if self.peek() == "not":
            self.take()
            return ("not", self.negation())
        return self._left(self.total, "==", "!=")

    def total(self) -> tuple:
        return self._left(self.filtered, "+")

    def filtered(self) -> tuple:
        tree = self.atom()
        while self.peek() == "|":
            self.take()
            if (name := self.take()) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def atom(self) -> tuple:
        token = self.take()
        if token == "(":
            tree = self.either()
            self.take(")")
            return tree
        if token[:1] in "'\"" and token:
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1], flags=re.S))
        if token.isdigit():
            return ("const", int(token))
        if token in ("true", "false"):
            return ("const", token == "true")
        if re.fullmatch(r"[A-Za-z_]\w*", token):
            name = token
            while self.peek() == ".":
                self.take()
                name += "." + self.take()
            return ("name", name)
        raise TemplateError(f"unexpected {token!r}")


def parse(template: str) -> tuple:
    """The template's syntax tree, a ``("block", parts)``."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))
    parts.reverse()

    def block(*ends: str) -> tuple[tuple, str]:
        out = []
        while parts:
            kind, body = parts.pop()
            word = body.split(None, 1)[0] if body.split() else ""
            if kind == "text":
                out.append(("emit", ("const", body)))
            elif kind == "out":
                out.append(("emit", _Expression(body).whole()))
            elif word in ends:
                return ("block", out), body
            elif word == "if":
                out.append(branch(body[2:]))
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", body)
                if not m:
                    raise TemplateError("a loop is over messages")
                out.append(("for", m[1], block("endfor")[0]))
            elif word == "generation":
                out.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {body!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return ("block", out), ""

    def branch(condition: str) -> tuple:
        body, end = block("elif", "else", "endif")
        word = end.split(None, 1)[0]
        rest = ("block", [])
        if word == "elif":
            rest = ("block", [branch(end[4:])])
        elif word == "else":
            rest = block("endif")[0]
        return ("if", _Expression(condition).whole(), body, rest)

    return block()[0]


def fold(tree: tuple) -> tuple:
    """The same tree with constant parts computed, dead branches cut and adjacent texts joined."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        inner = fold(tree[2])
        return ("const", FILTERS[tree[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind in _BINARY:
        a, b = fold(tree[1]), fold(tree[2])
        return ("const", _BINARY[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind == "not":
        inner = fold(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "emit":
        return ("emit", fold(tree[1]))
    if kind == "if":
        test = fold(tree[1])
        return fold(tree[2] if test[1] else tree[3]) if test[0] == "const" else ("if", test, fold(tree[2]), fold(tree[3]))
    if kind == "for":
        return ("for", tree[1], fold(tree[2]))
    if kind == "generation":
        return ("generation", fold(tree[1]))
    out: list[tuple] = []
    for part in tree[1]:
        folded = fold(part)
        for x in folded[1] if folded[0] == "block" else [folded]:
            if x[0] == "emit" and x[1][0] == "const" and out and out[-1][0] == "emit" and out[-1][1][0] == "const":
                out[-1] = ("emit", ("const", _text(out[-1][1][1]) + _text(x[1][1])))
            else:
                out.append(x)
    return ("block", out)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_BINARY: dict[str, Callable] = {
    "or": lambda a, b: a or b,
    "and": lambda a, b: a and b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
}

Piece = tuple[str, bool]


def _named(scope: dict, name: str):
    if name not in scope:
        raise TemplateError(f"unknown name {name}")
    return scope[name]


def _loops(tree: tuple) -> int:
    """How many loops can run, one after the other or in each other."""
    kind = tree[0]
    if kind == "block":
        return sum(map(_loops, tree[1]))
    if kind == "if":
        return max(_loops(tree[2]), _loops(tree[3]))
    return 1 + _loops(tree[2]) if kind == "for" else _loops(tree[1]) if kind == "generation" else 0


def _value(tree: tuple) -> Callable[[dict], object]:
    """A closure that computes an expression in a scope (a dict of dotted names)."""
    kind = tree[0]
    if kind == "const":
        return lambda scope, v=tree[1]: v
    if kind == "name":
        return lambda scope, n=tree[1]: _named(scope, n)
    if kind == "filter":
        return lambda scope, f=FILTERS[tree[1]], x=_value(tree[2]): f(_text(x(scope)))
    if kind == "not":
        return lambda scope, x=_value(tree[1]): not x(scope)
    return lambda scope, f=_BINARY[kind], a=_value(tree[1]), b=_value(tree[2]): f(a(scope), b(scope))


def _closure(tree: tuple, masked: bool = False) -> Callable[[dict, Iterable[dict]], Iterator[Piece]]:
    """A closure that yields the pieces of a statement."""
    kind = tree[0]
    if kind == "emit":
        value = _value(tree[1])
        return lambda scope, messages: iter(((_text(value(scope)), masked),))
    if kind == "generation":
        return _closure(tree[1], True)
    if kind == "if":
        test, yes, no = _value(tree[1]), _closure(tree[2], masked), _closure(tree[3], masked)
        return lambda scope, messages: (yes if test(scope) else no)(scope, messages)
    if kind == "for":
        name, body = tree[1], _closure(tree[2], masked)

        def loop(scope, messages):
            for i, message in enumerate(messages):
                inner = {**scope, "loop.first": i == 0, "loop.index": i + 1} | {f"{name}.{k}": v for k, v in message.items()}
                yield from body(inner, ())

        return loop
    parts = [_closure(x, masked) for x in tree[1]]

    def block(scope, messages):
        for part in parts:
            yield from part(scope, messages)

    return block


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A renderer: messages (dicts with role and text) in, (text, under the loss mask) pieces out.

    Messages are taken one by one and pieces are yielded as they are made, so that a
    conversation of any length needs the memory of one message.  Messages pass once: a
    template in which two loops can run is refused with TemplateError, as is a name that a
    message does not have when it is rendered.
    """
    tree = fold(parse(template))
    if _loops(tree) > 1:
        raise TemplateError("messages pass once: one loop only")
    run = _closure(tree)
    return lambda messages: run({}, iter(messages))


# ---------------------------------------------------------------- reading back

_MARK = re.compile("|".join(re.escape(c) for c in CONTROLS))


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in output of TEMPLATE, found by its marks alone.

    Pieces may be cut anywhere outside a mark; memory holds one turn.
    """
    held = ""
    for piece, _ in pieces:
        held += piece
        held, turns = _turns(held)
        yield from turns
    if _turns(held)[0]:
        raise ValueError("the output ends inside a turn")


#: Opening mark, closing mark and role of the template's turns.
_ENDS = {"[INST]": ("[/INST]", "user"), "[SYS]": ("[/SYS]", "system"), "[BOT]": ("</s>", "assistant"), "[ROLE]": ("</s>", None)}


def _turns(held: str) -> tuple[str, list[tuple[str, str]]]:
    """Whole turns at the start of ``held``, and what is left."""
    turns = []
    while True:
        first = _MARK.match(held)
        if first and first[0] == "<s>":
            held = held[3:]
            continue
        if not first:
            return held, turns
        end, role = _ENDS[first[0]]
        last = held.find(end, first.end())
        if last < 0:
            return held, turns
        body = held[first.end() : last]
        if role is None:
            name, _, body = body.partition("[/ROLE]")
            role = unescape(name)
        body = body[1:-1] if first[0] in ("[INST]", "[SYS]") else body[1:]
        turns.append((role, unescape(body)))
        held = held[last + len(end) :]


# ---------------------------------------------------------------- Spark

_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_RUNS = "conv_id long, part long, seq long, done boolean, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"
#: Bytes of content up to which a conversation is finished where it is formatted, and bytes of it in one row otherwise.
WHOLE, CHUNK = 1 << 20, 8192


def _turn_rows(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    """The turns of each conversation next to each other and in order, in one partition by key."""
    return _turn_rows(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _dealt_turns(conversations: DataFrame) -> DataFrame:
    """All turns in one order over the partitions; a long conversation lies in several.

    Partitions are cut by the first characters of role and text, so that bounds are short;
    the text counts only where the whole role does.
    """
    rows = _turn_rows(conversations)
    text = F.when(F.char_length("role") < 32, F.substring("text", 1, 32)).otherwise(F.lit(""))
    return rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), text).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, messages) of sorted rows; messages must be used up before the next."""
    rows = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    for key, group in groupby(rows, lambda x: x[0]):
        yield key, (m for _, m in group)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Pieces of each conversation's formatted text, in order: conv_id, piece, text, in_loss.

    Concatenating a conversation's pieces gives its text; a very long conversation is
    many rows, never one value.
    """

    def task(batches):
        render = compile_template(template)
        ids, numbers, texts, masks = [], [], [], []
        for key, messages in _conversations(batches):
            for i, (text, masked) in enumerate(render(messages)):
                ids.append(key), numbers.append(i), texts.append(text), masks.append(masked)
                if len(ids) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(masks, pa.bool_())], ["conv_id", "piece", "text", "in_loss"])
                    ids, numbers, texts, masks = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(masks, pa.bool_())], ["conv_id", "piece", "text", "in_loss"])

    return _sorted_turns(conversations).mapInArrow(task, "conv_id long, piece long, text string, in_loss boolean")


def format_digests(conversations: DataFrame, template: str = TEMPLATE, whole: int = WHOLE) -> DataFrame:
    """What is read back from each conversation's formatted text, as digests.

    One row for each conv_id (null is one of its own): n_turns, turns_sha256 (role,
    newline, text, newline for each turn), loss_chars and loss_sha256 (unescaped text
    under the loss mask), formatted_chars.  Null roles and texts are empty; equal turn
    numbers are ordered by role, then text; repeated rows are turns of their own.  An
    empty table gives no rows; other columns are ignored.

    Where the template formats each message alone (one outer loop, no ``loop.`` names, no
    turn open outside it), turns are dealt over tasks in order, whatever conversation they
    are of, and formatted and read back there; each message's output must read back by
    itself.  What was read back of conversations of more than ``whole`` bytes, and of those
    at the ends of a partition, goes in rows of CHUNK bytes to the task that computes the
    conversation's digests, which no other way gives.  Under other templates a conversation
    is formatted by one task, a turn at a time.
    """
    if (parts := _message_wise(template)) is not None:
        return _joined(_runs(_dealt_turns(conversations), *parts, whole), parts[0], parts[2])

    def task(batches):
        render = compile_template(template)
        out = []
        for key, messages in _conversations(batches):
            turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

            def watched(pieces, loss=loss, counts=counts):
                for text, masked in pieces:
                    counts[1] += len(text)
                    if masked:
                        plain = unescape(text)
                        counts[2] += len(plain)
                        loss.update(plain.encode())
                    yield text, masked

            for role, text in read_back(watched(render(messages))):
                turns.update(f"{role}\n{text}\n".encode())
                counts[0] += 1
            out.append((key, counts[0], turns.hexdigest(), counts[2], loss.hexdigest(), counts[1]))
            if len(out) >= 1000:
                yield _batch(out, _SCHEMA)
                out = []
        yield _batch(out, _SCHEMA)

    return _sorted_turns(conversations).mapInArrow(task, _SCHEMA)


def _names(tree) -> Iterator[str]:
    if isinstance(tree, tuple) and tree[0] == "name":
        yield tree[1]
    elif isinstance(tree, tuple | list):
        for x in tree:
            yield from _names(x)


#: What a stretch of output holds: its characters, and the unescaped text under the loss mask.
Stretch = tuple[int, str]


def _message_wise(template: str) -> tuple[Stretch, tuple, Stretch] | None:
    """What stands before the loop, the loop and what stands after it, if messages are formatted alone."""
    compile_template(template)
    parts = fold(parse(template))[1]
    loops = [i for i, x in enumerate(parts) if _loops(x)]
    if len(loops) != 1 or parts[loops[0]][0] != "for" or any(n.startswith("loop.") for n in _names(parts)):
        return None
    ends = [list(_closure(("block", x))({}, ())) for x in (parts[: loops[0]], parts[loops[0] + 1 :])]
    try:
        if any(list(read_back(x)) or _turns("".join(p for p, _ in x))[0] for x in ends):
            return None
    except ValueError:
        return None
    before, after = (_stretch(x) for x in ends)
    return before, parts[loops[0]], after


def _stretch(pieces: list[Piece]) -> Stretch:
    return sum(len(x) for x, _ in pieces), "".join(unescape(x) for x, masked in pieces if masked)


class _Run:
    """What was read back of one conversation's turns in one partition."""

    def __init__(self, key: int | None, part: int):
        self.key, self.part, self.seq = key, part, 0
        self._empty()

    def _empty(self) -> None:
        self.turns, self.loss = bytearray(), bytearray()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, pieces: list[Piece]) -> None:
        chars, plain = _stretch(pieces)
        for role, text in read_back(pieces):
            self.turns += f"{role}\n{text}\n".encode()
            self.n_turns += 1
        self.loss += plain.encode()
        self.loss_chars += len(plain)
        self.chars += chars

    def content(self) -> Iterator[tuple]:
        """Rows of what is held, which is then let go; the counts stand in the first."""
        counts = self.n_turns, self.loss_chars, self.chars
        for at in range(0, max(len(self.turns), len(self.loss), 1), CHUNK):
            n, loss_chars, chars = counts if at == 0 else (0, 0, 0)
            yield self.key, self.part, self.seq, False, n, bytes(self.turns[at : at + CHUNK]), loss_chars, bytes(self.loss[at : at + CHUNK]), chars
            self.seq += 1
        self._empty()


def _runs(turns: DataFrame, before: Stretch, loop: tuple, after: Stretch, whole: int) -> DataFrame:
    """One ``done`` row, of digests, for each small conversation that lies inside a partition, rows of content of the others."""

    def rows(batches):
        each, part = _closure(loop), TaskContext.get().partitionId()
        last, number = None, 0
        for key, messages in _conversations(batches):
            if last is not None:
                # The first of a partition may have turns in the one before.
                if number > 1 and not last.seq:
                    loss = hashlib.sha256(before[1].encode() + last.loss + after[1].encode())
                    yield last.key, part, 0, True, last.n_turns, hashlib.sha256(last.turns).digest(), last.loss_chars, loss.digest(), last.chars
                else:
                    yield from last.content()
            last, number = _Run(key, part), number + 1
            for message in messages:
                last.add(list(each({}, (message,))))
                if len(last.turns) + len(last.loss) > whole:
                    yield from last.content()
        if last is not None:
            yield from last.content()

    def task(batches):
        out, size = [], 0
        for key, part, seq, done, n, seen, loss_chars, loss, chars in rows(batches):
            out.append((key, part, seq, done, n, seen, loss_chars, loss, chars))
            size += len(seen) + len(loss) + 100
            if size > 1 << 22:
                yield _batch(out, _RUNS)
                out, size = [], 0
        yield _batch(out, _RUNS)

    return turns.mapInArrow(task, _RUNS)


def _joined(runs: DataFrame, before: Stretch, after: Stretch) -> DataFrame:
    """The digests of each conversation from its rows of ``_runs``."""

    def task(batches):
        out = []
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True))
        for key, group in groupby(rows, lambda r: r[0]):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(before[1].encode()), 0, len(before[1]) + len(after[1]), before[0] + after[0]
            whole = None
            for _, done, more, seen, more_loss, plain, more_chars in group:
                n, loss_chars, chars = n + more, loss_chars + more_loss, chars + more_chars
                if done:
                    whole = seen.hex(), plain.hex()
                else:
                    turns.update(seen), loss.update(plain)
            loss.update(after[1].encode())
            seen, plain = whole or (turns.hexdigest(), loss.hexdigest())
            out.append((key, n, seen, loss_chars, plain, chars))
            if len(out) >= 1000:
                yield _batch(out, _SCHEMA)
                out = []
        yield _batch(out, _SCHEMA)

    columns = "conv_id", "done", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"
    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select(*columns).mapInArrow(task, _SCHEMA)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))
