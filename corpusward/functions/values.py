"""JSON values in forms that are equal for equal values and for no others."""

from __future__ import annotations

import hashlib
import json
import re
from decimal import Decimal
from functools import reduce

#: Hexadecimal digits of a digest that fit a long.
HEX = 15


def typed(value) -> tuple[str, str]:
    """A JSON value as (class, text), equal for equal values and for no others; ``subtree_digests`` and ``number_text`` say the same of nodes."""
    if isinstance(value, bool) or value is None:
        return "literal", json.dumps(value)
    if isinstance(value, (int, float)):
        whole = isinstance(value, int) or value.is_integer()
        return "number", str(int(Decimal(repr(value)))) if whole else repr(value)
    if isinstance(value, str):
        return "string", value
    facts, todo = [], [("", value)]
    while todo:
        at, v = todo.pop()
        members = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        todo += [(f"{at}/{_token(str(k))}", x) for k, x in members]
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else typed(v)[0]
        facts.append(hashlib.sha256("\0".join((at, kind, "" if kind in ("object", "array") else typed(v)[1])).encode()).hexdigest())
    parts = [reduce(int.__xor__, (int(f[i : i + HEX], 16) for f in facts)) for i in range(0, 4 * HEX, HEX)]
    return ("object" if isinstance(value, dict) else "array"), ":".join(map(str, [len(facts), *parts]))


def _token(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


_encode = json.JSONEncoder(sort_keys=True, check_circular=False).encode
#: What the JSON of each float has, and that of no integer.
_FLOAT = re.compile(r"\d[.e]")


def _whole(value):
    """A value whose whole floats are integers."""
    if type(value) is float and value.is_integer():
        return int(Decimal(repr(value)))
    if type(value) is dict:
        return {k: _whole(v) for k, v in value.items()}
    return [_whole(v) for v in value] if type(value) is list else value


def _text(value) -> str:
    text = _encode(value)
    return _encode(_whole(value)) if _FLOAT.search(text) else text


def n_distinct(members: list) -> int:
    """How many different JSON values there are; 1 and 1.0 are equal, and so are objects whatever their keys' order."""
    try:
        return len(set(map(_text, members)))
    except RecursionError:  # nested too deep for it; all in one form, since forms are compared
        return len(set(map(typed, members)))
