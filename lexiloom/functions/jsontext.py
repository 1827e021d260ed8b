"""JSON of any depth: the standard reader, and one without recursion where a document is nested deeper than that allows."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_NAMED = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _refuse(x: str) -> None:
    raise ValueError(x)


def loads(text: str):
    """The document; ``ValueError`` if the text isn't valid JSON as a whole, which NaN and infinities aren't."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _deep(text)


def _deep(text: str):
    """One sweep with a stack of what is open: a list, or an object with the name that waits for its value."""
    at, end = _SPACE.match(text, 0).end(), len(text)
    stack: list[list] = []
    while True:
        c = text[at : at + 1]
        if c in ("[", "{"):
            value: object = [] if c == "[" else {}
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("]" if c == "[" else "}"):
                at += 1
            else:
                stack.append([value, None])
                if c == "{":
                    at = _name(text, at, stack[-1])
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in _NAMED and text.startswith(_NAMED[c][0], at):
            word, value = _NAMED[c]
            at += len(word)
        elif m := _NUMBER.match(text, at):
            value, at = (float(m.group()) if m.group(1) or m.group(2) else int(m.group())), m.end()
        else:
            raise ValueError(f"no value at {at}")
        while True:  # put the value where it belongs; close what ends behind it
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != end:
                    raise ValueError(f"text behind the document at {at}")
                return value
            holder, name = stack[-1]
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[name] = value
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(holder, dict):
                    at = _name(text, at, stack[-1])
                break
            if c != ("]" if isinstance(holder, list) else "}"):
                raise ValueError(f"no end at {at}")
            value, at = stack.pop()[0], at + 1


def _name(text: str, at: int, entry: list) -> int:
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    entry[1], at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return _SPACE.match(text, at + 1).end()
