"""JSON texts as trees: the one parse that schema drift and shredding share.

Numbers keep the text they are written with, so ``2.50`` stays ``2.50`` and
integers beyond 64 bits survive. Of repeated keys in one object the last wins.
A text nested deeper than the decoder goes is read without recursion.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring


class NumberText(str):
    """A JSON number as written."""

    __slots__ = ()


_DECODER = json.JSONDecoder(parse_int=NumberText, parse_float=NumberText, parse_constant=NumberText)


def parse(text: str | None):
    """The value of a JSON text; None for null, empty or malformed text."""
    if not text:
        return None
    try:
        return _DECODER.decode(text)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return _parse_deep(text)
    except (ValueError, IndexError):
        return None


_BLANK = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|NaN|-?Infinity|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str):
    """As the decoder, with a stack of its own for open arrays and objects; ValueError or IndexError if malformed."""
    skip = lambda i: _BLANK.match(text, i).end()
    top: list = []
    stack: list[tuple] = [(top, None)]  # open array or object and the key that waits for its value

    def key(at: int) -> tuple[str, int]:
        if text[at] != '"':
            raise ValueError("no key")
        name, at = scanstring(text, at + 1)
        at = skip(at)
        if text[at] != ":":
            raise ValueError("no colon")
        return name, skip(at + 1)

    at = skip(0)
    while True:
        # a value starts here
        into, name = stack[-1]
        mark = text[at]
        if mark in "[{":
            value = [] if mark == "[" else {}
            at = skip(at + 1)
        elif mark == '"':
            value, at = scanstring(text, at + 1)
        elif found := _PLAIN.match(text, at):
            word = found.group()
            value, at = _WORDS[word] if word in _WORDS else NumberText(word), found.end()
        else:
            raise ValueError("no value")
        if isinstance(into, list):
            into.append(value)
        else:
            into[name] = value
        if mark in "[{" and text[at] != ("]" if mark == "[" else "}"):
            name = None
            if mark == "{":
                name, at = key(at)
            stack.append((value, name))
            continue
        if mark in "[{":
            at += 1
        # the value is complete: what follows ends its parents or starts the next value
        while True:
            at = skip(at)
            if len(stack) == 1:
                if at != len(text):
                    raise ValueError("text after the value")
                return top[0]
            into, _ = stack[-1]
            mark = text[at]
            if mark == ("]" if isinstance(into, list) else "}"):
                stack.pop()
                at += 1
            elif mark == ",":
                at = skip(at + 1)
                if isinstance(into, dict):
                    name, at = key(at)
                    stack[-1] = (into, name)
                break
            else:
                raise ValueError("no comma")


def type_name(value) -> str:
    """string, number, boolean, array, object or null."""
    if value is None:
        return "null"
    if isinstance(value, NumberText):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    return "array" if isinstance(value, list) else "object"


def scalar_text(value) -> str | None:
    """Text of a scalar, as JSON writes it; None for null, arrays and objects."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, str) else None
